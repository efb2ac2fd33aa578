"""License scans: whole texts in canonical form, looked up by digest among known licences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import literal_table

# Spellings that count as equal.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing",
    "licencee": "licensee", "licencees": "licensees", "sublicence": "sublicense",
    "sublicences": "sublicenses", "sublicencing": "sublicensing", "sub licence": "sublicense",
    "sub license": "sublicense", "copyright owner": "copyright holder", "acknowledgement": "acknowledgment",
    "authorised": "authorized", "authorisation": "authorization", "favour": "favor", "fulfil": "fulfill",
    "merchantibility": "merchantability", "non commercial": "noncommercial", "organisation": "organization",
    "per cent": "percent", "recognise": "recognize", "https": "http", "whilst": "while", "wilful": "willful",
}
# Notice lines: the word with a year, a sign or a blank to fill in behind it, a sign with a name, and what often follows.
COPYRIGHT = (
    r"(?:^|\n)[^\n\p{L}\p{N}(©]*(?:"
    r"(?:portions )?copyright[\t ,:]*(?:\(c\)|©|[0-9]{4}|[<\[{])[^\n]*"
    r"|copyright[\t ][^\n]*[^0-9\n][0-9]{4}[\t .,]*"
    r"|\(c\)[\t ]*(?:[0-9]{4}|[<\[{])[^\n]*|©[\t ]*[\p{L}\p{N}<\[{][^\n]*"
    r"|all rights reserved[\t .]*)(?=\n|$)"
)

# Known licences in full, and notices that are a licence statement by themselves.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

""" + (DISCLAIMER := """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""")),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

""" + DISCLAIMER),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
]

# Title lines that may stand above a licence.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"],
    "ISC": ["ISC License", "The ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License"],
}

# Digests of the canonical forms of longer published licences, whole and without what follows their terms.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Apache-2.0", "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GFDL-1.3", "ccfa2750c2a3b9dae93f959cfa64078cc3a306c4a4cd4cfaf18365396202da90"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
]


def canonical(text: Column, spellings: Mapping[str, str] = SPELLINGS) -> Column:
    """Lower case, without copyright lines, words of letters and digits only, in one spelling, one blank between."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    out = F.regexp_replace(out, COPYRIGHT, "\n")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for variant, usual in spellings.items():  # every word has two blanks of its own
        out = F.replace(out, F.lit(f" {variant.replace(' ', '  ')} "), F.lit(f" {usual.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def variants(texts: Sequence[tuple[str, str]] = KNOWN, titles: Mapping[str, Sequence[str]] = TITLES) -> list[dict]:
    """Every known text as it is, and below each of the titles it may have."""
    plain = [{"license": name, "text": text} for name, text in texts]
    return plain + [{"license": name, "text": f"{title}\n{text}"} for name, text in texts if "\n" in text
                    for title in titles.get(name, ())]


def known(docs: DataFrame, texts: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(_digest, _license) of the known licences; one row per digest, the first name of several."""
    spark = docs.sparkSession
    rows = literal_table(spark, variants(texts), "license string, text string").select(
        digest(F.col("text")).alias("digest"), "license")
    more = literal_table(spark, [{"license": n, "digest": d} for n, d in digests], "license string, digest string")
    return rows.unionByName(more).groupBy(F.col("digest").alias("_digest")).agg(F.min("license").alias("_license"))


def scan(docs: DataFrame, texts: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """(doc_id, digest, license, last_line_license) for every row.

    ``license`` names the licence that the whole text is, ``last_line_license`` the one that its last line is, the
    usual place of a notice; else null. Wrapping, case, punctuation, titles, notice lines with any holder and year, and
    spellings make no difference; a text with anything besides is none of the known ones. Null is looked up like the empty
    text, which is no licence. Rows are looked up one by one, repeated rows too, in full whatever their length; where two
    names share a digest the first one counts; the hash join is with a fixed table; an empty table gives no rows.
    """
    table = known(docs, texts)
    last = F.element_at(F.split(F.trim(F.coalesce(F.col("text"), F.lit(""))), "\n"), -1)
    hashed = docs.select(F.col("doc_id").cast("bigint"), digest(F.col("text")).alias("digest"),
                         digest(last).alias("last"))
    whole = table.select(F.col("_digest").alias("digest"), F.col("_license").alias("license"))
    line = table.select(F.col("_digest").alias("last"), F.col("_license").alias("last_line_license"))
    return hashed.join(whole, "digest", "left").join(line, "last", "left").select(
        "doc_id", "digest", "license", "last_line_license")
