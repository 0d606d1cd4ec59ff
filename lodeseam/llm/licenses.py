"""License scans: the digest of a canonical text, hash-joined to those of known licences.

Canonical: lower case, without copyright lines, runs of anything but letters and digits as one space (so comment marks and
line breaks don't matter), equivalent spellings made one. The SHA-256 of an entire canonical text is joined to the table of
known digests. Lines that are entire notices are looked up as well. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "licenced": "licensed", "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "http": "https",
    "noncommercial": "non commercial", "percent": "per cent", "sublicense": "sub license", "copyrightholder": "copyright holder", "owner": "holder",
}

#: A copyright line, of lower-case text: one that begins, behind any marks, with a copyright statement. A line of a licence's
#: own words that happens to begin with "copyright" has no year, sign or "by" with it.
COPYRIGHT = (
    r"^[^\p{L}\p{N}\n]*(?:copyright\b(?:[^\n]*(?:\(c\)|©|\b(?:19|20)[0-9][0-9]\b|\byyyy\b|[\[<{(]year|all rights reserved)|[ \t]+by\b)"
    r"|(?:\(c\)|©)[^\p{L}\n]*(?:19|20)[0-9][0-9]\b|all rights reserved\b)[^\n]*"
)

# Digests of whole canonical licences, with and without their titles and what follows their terms.
DIGESTS = (
    ("0BSD", "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("0BSD", "9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153"),
    ("Apache-2.0", "c48d72ffbf1ca699b0788030ec8b39260f33f0f36829174a00296bb2151d09ad"),
    ("Apache-2.0", "c7c8052e39a06a64100e09ab734f09830b5a322df6c8a55505c4a577d57f0d9f"),
    ("Artistic-2.0", "a5a08badf4f858856e4ae957819d129c23951a120461f1afdc3b9ea889264f00"),
    ("BlueOak-1.0.0", "6cffa606d4960a0fadb3c8161a99b92c53dbe7b999697a5e26d35cfdc1d80f3d"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSL-1.0", "5fcf89bde8c0c2deb999f4cc626e1aebf90e80fdc5cd334dae008152ef4a1ded"),
    ("CC0-1.0", "6e4a79b7eaf2cdc3879a899ef330c98026c9d697ee87d41a28ac5159e8e53348"),
    ("GFDL-1.2", "b8a2445605b1deccba655f9c9e334bc6d85e8437a920bcbbcee2a3851c84a4e2"),
    ("GFDL-1.3", "c0d151f99548ceea3fa31d97247c0f89eb3d76623b711693a83b9684b7fb3839"),
    ("GPL-1.0", "160c74cee4013ca5418bd3648b4e205c6e0d38b5507407deffe7f5a5a9f31b60"),
    ("GPL-1.0", "47dcf5c10086f453e4166de00ce28e8af707c039d0ef0a906825c6276417bd5a"),
    ("GPL-2.0", "652aa03b0e13f5393ad2f49e9e203ef509d88747d904ab36b7ff23bc92c4a6f6"),
    ("GPL-2.0", "556e1aeccc7c80efead9e3ea7de1a97d6750abd7a671ad06221f910b2523f6ec"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("ISC", "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("ISC", "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee"),
    ("LGPL-2.0", "5df277a264b0db9f656dea052fa76d8fbe46620768b01b8f09f76ef719771d95"),
    ("LGPL-2.0", "cbd109b0c6f89b9ef02c3775dbb0c350fdaaaf298c25e2f53239fdf27ea7353e"),
    ("LGPL-2.1", "659bfcbba21e743ae02dd4d5518f6bf275275dfe701b5ff9c9b8d21e24d85589"),
    ("LGPL-2.1", "42d699361f3dbbebd075e8f918067cf0550ece0c733a8376d795b00265ef4398"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", "5eb4b7aeacabd59a945325e9f1db167909c6bb1f8da56cfe413f2ae244a903ad"),
    ("MIT", "d98f92794c87301c45c4642fb720fecde2a7c8034f1b3326fe379b17ec164528"),
    ("MIT", "402c34d0a40cd8e70b6b2212e3fd8bff43ce4ce9bcbcf4dd37a08e3bbf7d767c"),
    ("MPL-1.1", "f23ce5cd75f6614af70e1819dfda63c8fac34a3e7d6650e2f56e817341562c79"),
    ("MPL-2.0", "05489d56ecf0ca6003c6bbd52225d37f04c3fae5d55bff0135beb54ead660594"),
    ("Unicode-3.0", "53113a39b79251016cf92b8348f303cee44e4faee1f232536754abc669dd32c8"),
    ("Unlicense", "fd1b07be5f4f94926b6ea4df3943b05ab90c1a1f3b1a3d574ae7ab58bca58fff"),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
    ("Zlib", "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a"),
)

# One-line notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"), ("MIT", "Licensed under the MIT License"), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"), ("CC-BY-4.0", "This work is licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"), ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Released under CC0 1.0"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)


def _any_spelling() -> str:
    return r"\b(?:" + "|".join(SPELLINGS) + r")\b"


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that have a word, one line feed apart."""
    lower = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "(?md)" + COPYRIGHT, "")
    plain = F.regexp_replace(lower, r"[^\p{L}\p{N}\n]+", " ")
    tidy = F.trim(F.regexp_replace(plain, r" *\n[ \n]*", "\n"), F.lit(" \n"))
    pairs = F.array(*[F.struct(F.lit(rf"\b{a}\b").alias("a"), F.lit(b).alias("b")) for a, b in SPELLINGS.items()])
    # few texts have any of these spellings
    return F.when(F.regexp_like(tidy, F.lit(_any_spelling())), F.aggregate(pairs, tidy, lambda t, p: F.regexp_replace(t, p["a"], p["b"]))).otherwise(tidy)


def digest(lines: Column) -> Column:
    """The digest of a whole text from its canonical lines."""
    return F.sha2(F.replace(lines, F.lit("\n"), F.lit(" ")), 256)


def notices() -> dict[str, str]:
    """Canonical notice -> licence. The notices have none of the equivalent spellings and are plain ASCII."""
    return {" ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()): n for n, t in NOTICES}


def known(spark: SparkSession) -> DataFrame:
    """(text_sha256, license): a row for each of DIGESTS."""
    return spark.createDataFrame([(d, n) for n, d in DIGESTS], "text_sha256 string, license string")


def scan(docs: DataFrame, further: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_sha256, license, notices) of every row: the digest of the whole canonical text, the licence that the
    entire text is (or null), and the licences of lines that are entire notices, sorted.

    A null or empty text, or one without a word, has the digest of an empty text, no licence and no notices. Very long texts
    are read whole like others. Repeated rows and rows of equal or null doc_id are looked at alone; other columns are ignored,
    whatever their names; an empty table gives no rows. `further` has (text_sha256, license) of more whole texts, as this
    function gives them; what is known here comes first, then, at a tie, the first name of a digest. Only the table of
    known digests, which has a fixed size, is broadcast by hand.
    """
    of_notice = notices()
    names = F.create_map(*[F.lit(x) for pair in of_notice.items() for x in pair])
    found = lambda lines: F.array_sort(F.array_distinct(F.transform(F.filter(lines, lambda x: x.isin(*of_notice)), lambda x: F.element_at(names, x))))
    # the lines are worked out once: a projection of its own would be merged into this one
    each = F.get(F.transform(F.array(canonical_lines(F.col("text"))), lambda t: F.struct(digest(t).alias("sha"), found(F.split(t, "\n")).alias("notices"))), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), each.alias("x")).select("doc_id", F.col("x.sha").alias("text_sha256"), F.col("x.notices").alias("notices"))
    table = F.broadcast(known(docs.sparkSession))
    if further is not None:
        more = further.select(F.col("text_sha256").cast("string").alias("text_sha256"), F.col("license").cast("string").alias("license")).join(table, "text_sha256", "left_anti")
        table = known(docs.sparkSession).unionByName(more.groupBy("text_sha256").agg(F.min("license").alias("license")))
    return rows.join(table, "text_sha256", "left").select("doc_id", "text_sha256", "license", "notices")
