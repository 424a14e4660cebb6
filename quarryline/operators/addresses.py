"""An index of addresses, and what a reader gets for an address under a budget of tokens.

An object is a source (a document), a page, a block of a page or a region of a page. The index is one table, partitioned by a hash of the document
and sorted by document, page, kind and number: an address reads one partition's files, and of those the row groups around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import token_estimate
from quarryline.sources.shared import new_path

SHARDS = 64
# The budget where none is given, and what a figure costs.
BUDGET, FIGURE = 4000, 64
PREFIX = "store://carrier"
PATTERN = rf"^{PREFIX}/docs/([^/]+)/(?:source|pages/([0-9]{{6}})(?:/(blocks|regions)/([0-9]{{4}}))?)$"


def shard(doc: Column) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(SHARDS)).cast("int")


def parsed(address: Column) -> Column:
    """kind (source, page, block, region; null of what is no address), doc, page and number of an address; 0 where it names none."""
    part = lambda i: F.regexp_extract(address, PATTERN, i)
    number = lambda i: F.coalesce(part(i).try_cast("long"), F.lit(0))
    kind = F.when(~F.coalesce(address.rlike(PATTERN), F.lit(False)), None).when(part(3) == "blocks", "block").when(part(3) == "regions", "region").when(part(2) != "", "page").otherwise("source")
    return F.struct(kind.alias("kind"), part(1).alias("doc"), number(2).alias("page"), number(4).alias("number"))


def page_address(doc: Column, page: Column) -> Column:
    return F.concat(F.lit(f"{PREFIX}/docs/"), doc, F.lit("/pages/"), F.lpad(page.cast("string"), 6, "0"))


def objects(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """The objects of blocks (doc, page, number, text) and regions (doc, page, number, region_kind, text).

    A page is its blocks: it has their numbers and costs, in order, and its own cost, but no copy of their text; a source has its cost alone.
    """
    size = F.octet_length("text").cast("long")
    none = F.lit(None).cast("array<struct<number:long,cost:long>>").alias("parts")
    own = blocks.select("doc", "page", F.lit("block").alias("kind"), F.col("number").cast("long").alias("number"), token_estimate(F.col("text")).alias("cost"), F.lit("").alias("region_kind"), none, "text")
    cost = F.when(F.col("region_kind") == "figure", FIGURE).otherwise(token_estimate(F.col("text"))).cast("long")
    seen = regions.select("doc", "page", F.lit("region").alias("kind"), F.col("number").cast("long").alias("number"), cost.alias("cost"), "region_kind", none, "text")
    quarter = lambda n: F.floor((n + 3) / 4)
    listed = F.array_sort(F.collect_list(F.struct(F.col("number").cast("long").alias("number"), token_estimate(F.col("text")).alias("cost"))))
    pages = blocks.groupBy("doc", "page").agg(F.sum(size).alias("bytes"), listed.alias("parts")).select(
        "doc", "page", F.lit("page").alias("kind"), F.lit(0).cast("long").alias("number"), quarter(F.col("bytes")).alias("cost"), F.lit("").alias("region_kind"), "parts", F.lit(None).cast("string").alias("text"),
    )
    sources = blocks.groupBy("doc").agg(F.sum(size).alias("bytes")).select(
        "doc", F.lit(0).cast("long").alias("page"), F.lit("source").alias("kind"), F.lit(0).cast("long").alias("number"), quarter(F.col("bytes")).alias("cost"), F.lit("").alias("region_kind"), none, F.lit(None).cast("string").alias("text"),
    )
    return own.unionByName(seen).unionByName(pages).unionByName(sources)


def indexed(table: DataFrame, path: str | None = None) -> DataFrame:
    """The objects, written as an index to path (or the shared folder) and read again."""
    spark = table.sparkSession
    path = path or new_path(spark, "addresses")
    placed = table.withColumn("shard", shard(F.col("doc")))
    order = ["shard", "doc", "page", "kind", "number"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def looked_up(index: DataFrame, address: str) -> DataFrame:
    """The object of one address, or with a / at its end all objects below it: a scan of one shard, pruned by document and page."""
    spark = index.sparkSession
    point = spark.range(1).select(parsed(F.lit(address.rstrip("/"))).alias("a"), shard(F.regexp_extract(F.lit(address.rstrip("/")), PATTERN, 1)).alias("s")).first()
    a = point["a"]
    if a["kind"] is None:
        raise ValueError(f"no address: {address}")
    found = index.where((F.col("shard") == point["s"]) & (F.col("doc") == a["doc"]))
    if a["kind"] != "source":
        found = found.where(F.col("page") == a["page"])
    if not address.endswith("/"):
        found = found.where((F.col("kind") == a["kind"]) & (F.col("number") == a["number"]))
    return found


def expanded(index: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, status, reason, used, taken, refs) of requests (request_id, address, fidelity, max_tokens): all in one join.

    Exact, which is what a request without a fidelity asks for, is all or nothing: what costs more than the budget is UNKNOWN with
    BUDGET_EXCEEDED_EXACT, a page then with its blocks to ask for. A page that needn't be exact gives those of its blocks, in order, that fit what
    is left of the budget, and names the rest. A budget of none or less is the default. Sources are never given to a reader.
    """
    asked = requests.select("request_id", parsed(F.col("address")).alias("a"), F.col("address"), F.coalesce(F.nullif("fidelity", F.lit("")), F.lit("exact")).alias("fidelity"), F.when(F.col("max_tokens") > 0, F.col("max_tokens")).otherwise(BUDGET).cast("long").alias("budget"))
    asked = asked.select("request_id", "address", "fidelity", "budget", F.col("a.kind").alias("a_kind"), F.col("a.doc").alias("a_doc"), F.col("a.page").alias("a_page"), F.col("a.number").alias("a_number"), shard(F.col("a.doc")).alias("a_shard"))
    on = (F.col("a_shard") == F.col("shard")) & (F.col("a_doc") == F.col("doc")) & (F.col("a_page") == F.col("page")) & (F.col("a_kind") == F.col("kind")) & (F.col("a_number") == F.col("number"))
    # no text is read to decide
    j = asked.join(index.select("shard", "doc", "page", "kind", "number", "cost", "parts"), on, "left")
    start = F.struct(F.col("budget").alias("left"), F.array().cast("array<bigint>").alias("taken"), F.array().cast("array<bigint>").alias("rest"))

    def step(s: Column, b: Column) -> Column:
        fits = b["cost"] <= s["left"]
        return F.struct(
            F.when(fits, s["left"] - b["cost"]).otherwise(s["left"]).alias("left"), F.when(fits, F.array_append(s["taken"], b["number"])).otherwise(s["taken"]).alias("taken"),
            F.when(fits, s["rest"]).otherwise(F.array_append(s["rest"], b["number"])).alias("rest"),
        )

    exact, over = F.col("fidelity") == "exact", F.col("cost") > F.col("budget")
    is_page = F.col("kind") == "page"
    j = j.withColumn("s", F.when(is_page & ~exact, F.aggregate("parts", start, step)))
    reason = (
        F.when(F.col("a_kind").isNull(), "INVALID_ADDRESS").when(F.col("cost").isNull(), "NOT_FOUND").when(F.col("kind") == "source", F.when(over, "BUDGET_EXCEEDED_EXACT_SOURCE").otherwise("SOURCE_NOT_GIVEN"))
        .when(is_page & ~exact, F.when(F.size("s.taken") == 0, "NO_BLOCK_FITS")).when(over, F.when(exact | (F.col("kind") == "region"), "BUDGET_EXCEEDED_EXACT").otherwise("BUDGET_EXCEEDED"))
    )
    j = j.withColumn("reason", F.coalesce(reason, F.lit("")))
    given = F.col("reason") == ""
    block = lambda numbers: F.transform(numbers, lambda n: F.concat(F.col("address"), F.lit("/blocks/"), F.lpad(n.cast("string"), 4, "0")))
    nothing = F.array().cast("array<string>")
    taken = F.when(~given, nothing).when(is_page & ~exact, block(F.col("s.taken"))).otherwise(F.array("address"))
    refs = F.when(is_page & exact & ~given, block(F.transform("parts", lambda p: p["number"]))).when(is_page & ~exact, block(F.col("s.rest"))).otherwise(nothing)
    used = F.when(~given, 0).when(is_page & ~exact, F.col("budget") - F.col("s.left")).otherwise(F.col("cost"))
    return j.select("request_id", F.when(given, "GIVEN").otherwise("UNKNOWN").alias("status"), "reason", used.cast("long").alias("used"), taken.alias("taken"), refs.alias("refs"))


def contents(index: DataFrame, resolved: DataFrame) -> DataFrame:
    """(request_id, address, number, text): what the taken addresses hold; a page gives its blocks, which joined in order are the page."""
    t = resolved.select("request_id", F.explode("taken").alias("address")).select("request_id", "address", parsed(F.col("address")).alias("a"))
    t = t.select("request_id", "address", F.col("a.kind").alias("a_kind"), F.col("a.doc").alias("a_doc"), F.col("a.page").alias("a_page"), F.col("a.number").alias("a_number"), shard(F.col("a.doc")).alias("a_shard"))
    own = (F.col("a_kind") == F.col("kind")) & (F.col("a_number") == F.col("number")) & (F.col("a_kind") != "page")
    one = own | (F.col("a_kind") == "page") & (F.col("kind") == "block")
    on = (F.col("a_shard") == F.col("shard")) & (F.col("a_doc") == F.col("doc")) & (F.col("a_page") == F.col("page")) & one
    return t.join(index, on).select("request_id", "address", "number", "text")
