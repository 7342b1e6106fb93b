"""Licence scan by canonical digest lookup.

Known are notices and short licences by their texts, long licences by the
digests of theirs.  A known text and every whole unit of a document (the whole text, each
paragraph, each line) are put in canonical form: lower case, copyright lines
removed, all punctuation and white space runs made one space, equivalent
spellings unified.  Lines without a letter or digit, and copyright lines, end
a paragraph.  Units are hash-joined by
SHA-256 of that form, so only entire texts match, never fragments.

Units are exploded map-side as digests only; texts are not shuffled.  The
licence table is a parameter; its digests are joined by Spark's own choice
(it broadcasts them when their size is small).

Defined results: null and empty texts, and units without letters or digits,
match nothing; one row per (document row key, licence, scope); rows repeated
in the input are counted in ``n_units``; a null doc_id is reported as null;
an empty table or licence list gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import materialize

# SPDX ids with notice and licence texts.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                   "compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
)
_WARRANTY = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
             "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
             "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
             "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_START = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
              "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
              "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
              "documentation and/or other materials provided with the distribution.")
_BSD_NAME = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
             "software without specific prior written permission.")
_BSD_END = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
            "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
            "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
            "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
            "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _WARRANTY)
_ISC_END = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
            "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
            "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
            "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
# Short licences by paragraph; each is known whole, with and without its title, and by its granting paragraph where that is its own.
SHORT = (
    ("MIT", "MIT License", _MIT, _MIT[0]),
    ("ISC", "ISC License", (KNOWN[-1][1], _ISC_END), None),
    ("BSD-2-Clause", "BSD 2-Clause License", (*_BSD_START, _BSD_END), None),
    ("BSD-3-Clause", "BSD 3-Clause License", (*_BSD_START, _BSD_NAME, _BSD_END), None),
)
# SHA-256 of the canonical form of long licences: the whole text and, where the text marks their end, the terms with and without that
# mark.  Made by ``digests_of`` from the texts as distributions ship them.
DIGESTS = (
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Apache-2.0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "0c3e4ca5ed7ced6289d3f5d9a83e4100f9f34d87983b17dc5865376a8a0a98f3"),
    ("GFDL-1.2-only", "3779b330e99c7f3bdc3960eb600b6a9f0525a3083a584e007eae51fbfafb9503"),
    ("GFDL-1.3-only", "ebc843a1ef1c4de8bd430a9c1af32c04434f49e7d50574896fdec45cc13bfc02"),
    ("GPL-1.0-only", "a39d7cceab675e14bdc24e269448ac0ed44fdef25178b183064cd4b35b8d2e7b"),
    ("GPL-1.0-only", "91b305cf86edf86f06cf0d2e2fd9a19411380eed7bcaf9a3cfd5df4653d4fa22"),
    ("GPL-1.0-only", "623616c29d1b130de555ac918949fb7b05b67711999871d9d8f68d4639e91089"),
    ("GPL-2.0-only", "cf74dfa78ca9ac981c7ae9e50c4ecfb828df2e5ef2f1646368388676215766b5"),
    ("GPL-2.0-only", "c33d2f29477d94c3f3e48ae230c47966a4f4c05a0f6087cf607e1589848d2986"),
    ("GPL-2.0-only", "255577de4e1e5d93258ddab6c40c41231b97e109d43f4b552501c6d77285763b"),
    ("GPL-3.0-only", "1586d648cc0a3af2b1181d7c0147880c62dbf50b84b0d049bd2b69600021a97f"),
    ("GPL-3.0-only", "6cc8b6be633f4b0e03cf2fb9741c1b165b497be5b666f1cad3901fbdf3e138c8"),
    ("GPL-3.0-only", "fa84ebf9883589b64d35e21c9b9ec18325598fd6975474a4bde27913a0272ac5"),
    ("LGPL-2.0-only", "1862ecc2c3c5e3b9e88481e95603c88e089c43e9d5702b2ec01391491b606a9e"),
    ("LGPL-2.0-only", "e29dcc167f8a363847b3c4b0a7ced67d7a2bb7b9112a3311b6877a9c0570d635"),
    ("LGPL-2.0-only", "b927da98cda221c8fbc56dfd2b6b2e80f6df686482d12dbac6b79da1ce6bb98a"),
    ("LGPL-2.1-only", "ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5"),
    ("LGPL-2.1-only", "2858f5a00f6672bd47f63b69b9bf4e1bc31f3541b08a5a263e59d9b384f72fdc"),
    ("LGPL-2.1-only", "2a9689b90bf823adea3df9024818d21d6041c74f3f12ab46ac5ac4d86f654b2e"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "e7395b2a4928053d99e28f31b0f3291170797effc7bb2a5a024427c653c1b941"),
)
TERMS_END = "END OF TERMS AND CONDITIONS"
# Spellings that mean the same in licence texts.
EQUIVALENT = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licensing", "license"), ("sublicence", "sublicense"),
              ("organisation", "organization"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"),
              ("ver", "version"), ("v", "version"), ("cc by nc", "ccbync"), ("per cent", "percent"), ("copyright holder", "copyright owner"))
PARAGRAPH_END = r"\n(?: *\n)+"
COPYRIGHT_LINE = r"(?m)^[^\S\n]*(?:(?:copyright\b|\(c\))[^\n]*[0-9]{4}|copyright\b[^\n]*(?:\(c\)|©)|©|all rights reserved)[^\n]*$"


def _words(text: Column) -> Column:
    """Lower case without copyright lines; everything but letters, digits and line breaks is one space."""
    low = F.lower(text)
    hinted = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©")) | F.contains(low, F.lit("all rights reserved"))
    return F.regexp_replace(F.when(hinted, F.regexp_replace(low, COPYRIGHT_LINE, " ")).otherwise(low), r"[^\p{L}\p{N}\n]+", " ")


def _unified(words: Column) -> Column:
    """One unit's words with line breaks as spaces and equivalent spellings unified."""
    t = F.when(F.contains(words, F.lit("\n")), F.regexp_replace(words, r" *\n[ \n]*", " ")).otherwise(words)
    t = F.concat(F.lit(" "), F.trim(t), F.lit(" "))
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def canonical(text: Column) -> Column:
    """Canonical form of one unit; empty when nothing is left."""
    return _unified(_words(text))


def known_texts() -> list[tuple[str, str]]:
    """(SPDX id, text) of what is known by its text."""
    out = list(KNOWN)
    for name, title, paragraphs, grant in SHORT:
        body = "\n\n".join(paragraphs)
        out += [(name, body), (name, f"{title}\n\n{body}"), *([(name, grant)] if grant else [])]
    return out


def known_licenses(spark: SparkSession, known=None, digests=DIGESTS) -> DataFrame:
    """(license_id, text, digest): one of text and digest is null."""
    rows = [(i, t, None) for i, t in (known_texts() if known is None else known)] + [(i, None, d) for i, d in (digests if known is None else ())]
    return spark.createDataFrame(rows, "license_id string, text string, digest string")


def digests_of(texts: DataFrame) -> DataFrame:
    """(license_id, digest) of licence texts (license_id, text): the entries of ``DIGESTS``."""
    cut = F.instr("text", TERMS_END)
    parts = F.when(cut > 0, F.array("text", F.substring("text", F.lit(1), cut - 1 + len(TERMS_END)), F.substring("text", F.lit(1), cut - 1))).otherwise(F.array("text"))
    return texts.select("license_id", F.explode(parts).alias("t")).select("license_id", F.sha2(canonical(F.col("t")), 256).alias("digest"))


def scan(docs: DataFrame, licenses: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license_id, scope, n_units): units of a document that are entire known licence texts."""
    # written once: Spark sees how small it is and broadcasts it, or shuffles the digests when it is not
    given = F.col("digest") if "digest" in licenses.columns else F.lit(None).cast("string")
    digests = materialize(licenses.select("license_id", given.alias("digest"), canonical(F.col("text")).alias("c"))
                          .select("license_id", F.coalesce("digest", F.when(F.col("c") != "", F.sha2("c", 256))).alias("_digest"))
                          .where("_digest is not null").distinct(), "license-digests")
    w = F.col("_w")
    unit = lambda scope: (lambda u: F.struct(F.lit(scope).alias("scope"), u.alias("unit")))
    none = F.array().cast("array<struct<scope:string,unit:string>>")
    lines = F.when(F.contains(w, F.lit("\n")), F.transform(F.split(w, r"\n"), unit("line")))
    blocks = F.when(w.rlike(PARAGRAPH_END), F.transform(F.split(w, PARAGRAPH_END), unit("paragraph")))
    units = F.concat(F.array(F.struct(F.lit("document").alias("scope"), w.alias("unit"))),
                     F.coalesce(blocks, none), F.coalesce(lines, none))
    found = (docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), _words(F.col(text)).alias("_w"))
             .select("doc_id", F.explode(units).alias("u"))
             .select("doc_id", "u.scope", _unified(F.col("u.unit")).alias("c")).where(F.col("c") != "")
             .select("doc_id", "scope", F.sha2("c", 256).alias("_digest")))
    return (found.join(digests, "_digest").groupBy("doc_id", "license_id", "scope")
            .agg(F.count("*").alias("n_units")))
