"""Guest inventory documents (a JSON array for each host and time) to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalars import truncated


def guests(documents: DataFrame) -> DataFrame:
    """Rows of the array in `content`, with the other columns of documents kept.

    Elements that are not objects, not lxc or qemu, without a node, or whose vmid is not a JSON number from 0 to
    2**32 - 1 are skipped. Names default to the type, status to 'unknown', sizes to 0 and negative ones to 0; texts are
    cut at 256 bytes. A document that is no array gives no rows: see broken().
    """
    keys = [c for c in documents.columns if c != "content"]
    items = documents.select(*keys, F.explode(F.expr("try_cast(try_parse_json(content) AS array<variant>)")).alias("g"))
    text = lambda key: truncated(F.when(F.schema_of_variant(F.try_variant_get("g", f"$.{key}", "variant")) == "STRING", F.try_variant_get("g", f"$.{key}", "string")), 256)
    size = lambda key: F.greatest(F.coalesce(F.try_variant_get("g", f"$.{key}", "double").cast("decimal(38,0)").try_cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    kind = F.schema_of_variant(F.try_variant_get("g", "$.vmid", "variant"))
    number = F.try_variant_get("g", "$.vmid", "double")
    numeric = F.coalesce(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.lit(False))
    rows = items.filter(F.schema_of_variant("g").startswith("OBJECT") & numeric & number.between(0, 2**32 - 1))
    out = rows.select(*keys, F.floor(number).cast("long").alias("vmid"), text("name").alias("_name"), text("node").alias("node"), text("type").alias("type"), F.coalesce(text("status"), F.lit("unknown")).alias("status"), size("maxmem").alias("maxmem"), F.coalesce(F.try_variant_get("g", "$.maxcpu", "double"), F.lit(0.0)).alias("maxcpu"), size("uptime").alias("uptime"))
    kept = out.filter(F.col("type").isin("lxc", "qemu") & F.col("node").isNotNull())
    return kept.select(*keys, "vmid", F.coalesce("_name", "type").alias("name"), "node", "type", "status", "maxmem", "maxcpu", "uptime")


def broken(documents: DataFrame) -> DataFrame:
    """Documents that are not a JSON array."""
    return documents.filter(F.expr("try_cast(try_parse_json(content) AS array<variant>)").isNull())
