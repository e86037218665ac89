"""Separating an address from what else a delivery text holds: mail, phones, order numbers, recipients, companies, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, applied in this order; what they match is taken out and listed.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
ORDER = r"(?i)\b(?:ORDER|ORD|INVOICE|INV|PO|TRACKING|AWB|REF)\s*(?:NO\.?|NUMBER|ID|#)?\s*[:#]?\s*[A-Z]{0,4}-?[0-9]{5,}\b"
PHONE = r"(?i)(?:\b(?:TEL|PHONE|HP|MOBILE|CONTACT|CALL)\s*[:.]?\s*)?(?:\+?65[ -]?)?(?<![0-9])[3689][0-9]{3}[ -]?[0-9]{4}(?![0-9])"
RECIPIENT = r"(?i)^\s*(?:C/O|CARE OF|ATTN|ATTENTION|ATT|RECIPIENT|DELIVER TO|TO|FAO)\b\s*[:.]?\s*|^\s*(?:MR|MRS|MS|MDM|DR|MISS)\b\.?\s+"
COMPANY = r"(?i)\b(?:PTE\.?\s*LTD|PRIVATE LIMITED|LTD|LLP|SDN BHD|INC|CORP)\b\.?"
NOTE = r"(?i)\b(?:PLEASE|PLS|LEAVE|LEFT AT|CALL|RING (?:THE )?BELL|DELIVER|AFTER|BEFORE|URGENT|FRAGILE|NEAR|OPPOSITE|OPP|BESIDE|NEXT TO|BEHIND|LIFT LOBBY|GUARD HOUSE)\b"


def separate(df: DataFrame, column: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Adds ``clean`` and the lists emails, orders, phones, recipients, companies, notes.

    ``known`` (column segment, upper case) lists texts that are addresses: a segment among them is never taken for noise.
    Fixed formats go first, each replaced by a comma; then every segment between commas is judged by itself.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    lists = {}
    for name, pattern in (("emails", EMAIL), ("orders", ORDER), ("phones", PHONE)):
        lists[name] = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: F.trim(s))
        text = F.regexp_replace(text, pattern, " , ")
    # a floor and unit, or a postcode in brackets, must not be cut
    segments = F.filter(F.transform(F.split(text, r"[,;\n]+"), lambda s: F.trim(s)), lambda s: s != "")
    out = df.withColumns(lists | {"__s": segments})
    if known is not None:
        safe = known.select(F.upper("segment").alias("__k")).distinct()
        hit = out.select(F.explode("__s").alias("s")).distinct().join(safe, F.upper("s") == F.col("__k"), "left_semi").select("s", F.lit(True).alias("ok"))
        # what a list of segments is taken for doesn't depend on the row, so equal rows stay apart
        said = out.select("__s").distinct().select("__s", F.posexplode_outer("__s").alias("i", "s")).join(hit, "s", "left")
        item = F.when(F.col("s").isNotNull(), F.struct("i", "s", F.coalesce("ok", F.lit(False)).alias("ok")))
        said = said.groupBy("__s").agg(F.array_sort(F.collect_list(item)).alias("__j")).select("__s", F.transform("__j", lambda x: F.struct(x.s.alias("s"), x.ok.alias("ok"))).alias("__j"))
        out = out.join(said, "__s")
    else:
        out = out.withColumn("__j", F.transform("__s", lambda s: F.struct(s.alias("s"), F.lit(False).alias("ok"))))

    def kind(x: Column) -> Column:
        return F.when(x.ok, "address").when(x.s.rlike(RECIPIENT), "recipients").when(x.s.rlike(COMPANY), "companies").when(x.s.rlike(NOTE) & ~x.s.rlike("[0-9]{6}"), "notes").otherwise("address")

    of = lambda k: F.transform(F.filter("__j", lambda x: kind(x) == k), lambda x: x.s)
    out = out.withColumns({"recipients": F.transform(of("recipients"), lambda s: F.trim(F.regexp_replace(s, RECIPIENT, ""))), "companies": of("companies"), "notes": of("notes"), "clean": F.array_join(of("address"), ", ")})
    return out.drop("__s", "__j")
