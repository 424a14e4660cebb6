"""Main text of pages, by the templates of their hosts (operator 8).

Tokens of a page are its elements and its blocks of text, each with its path of elements. Tokens of a host that occur
equally often on each of its pages form an equivalence class. The root is the class of most tokens among those on half of
the host's pages or more; pages without any token are no pages of a host. A class of three tokens or more is valid if it
stands on three different articles or more, its tokens stand in the same order on each page and, unless it is the root,
all between the same two tokens of the root wherever a page has the root. The valid classes are the host's template.
Articles are different if they differ in what is in no class. For a class other than the root a page counts only if the
class is at most half of the page's text: copies of one article share their paragraphs, too.
The template's elements open slots. What an element of the root holds, or what the element around it holds, is a slot of
every page; of each the running text (blocks of no valid class, less what stands in links) is summed up over the host's
pages, whatever the names of its elements and classes. The article's slot is the smallest with half of the host's running
text, widened to larger ones as long as what they add is not links for more than a quarter. The main text is what fills
it, less the blocks of the template; what tags set aside inside it stays out, unless that is all of it.
Where no slot has half of the running text (short articles), the root cuts a page at its tokens: such a slot is the article's
if most of its text on the host's pages is, by the pages that mark their article if there are such.
If nothing is left the page keeps what its tags give. Pages whose tags set all their text aside have none to tell articles
apart by, so a host of such pages alone has no root. Pages of hosts without a root, pages without the root of their host
and pages without a host go by their tags.
Null and empty html give an empty text. Pages are read whole; rows that repeat are rows of their own; an empty table
gives an empty result; columns beside page_id, url and html aren't read, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quarryline.llm.common import bounded_batches, written
from quarryline.llm.htmlblocks import main_blocks, parse
from quarryline.llm.neardup import MOST_SENT, few

#: Least tokens of a valid class, and least different articles it stands on.
TOKENS, PAGES = 3, 3

COUNTED = T.StructType([T.StructField("token", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in ("n", "first", "last", "mains", "chars")]])
PARSED = T.StructType([
    T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.IntegerType())),
    T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("marked", T.BooleanType()), T.StructField("counts", T.ArrayType(COUNTED)),
    T.StructField("depths", T.ArrayType(T.IntegerType())), T.StructField("links", T.ArrayType(T.IntegerType())),
    T.StructField("asides", T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("aside", T.BooleanType())]))),
])
SLOT = T.ArrayType(T.StructType([T.StructField("token", T.LongType()), T.StructField("around", T.BooleanType()), T.StructField("running", T.LongType()), T.StructField("links", T.LongType())]))
SPAN = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
ASIDES = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.string()), ("aside", pa.bool_())]))


def _nested(depths: list[int], chars: list[int]) -> tuple[list[int], list[int]]:
    """For each token where what it holds ends, and the place of the element around it, -1 if there is none of one depth less."""
    ends, around, open_ = [len(depths)] * len(depths), [-1] * len(depths), []
    for i, d in enumerate(depths):
        while open_ and depths[open_[-1]] >= d:
            ends[open_.pop()] = i
        if open_ and depths[open_[-1]] == d - 1:
            around[i] = open_[-1]
        if not chars[i]:
            open_.append(i)
    return ends, around


@arrow_udf(SLOT)
def slots_of(tokens: pa.Array, chars: pa.Array, links: pa.Array, depths: pa.Array, gone: pa.Array, root: pa.Array) -> pa.Array:
    """Of a page its running text and its link text outside the template (token null), and those of what each element of the root holds, and of what the element around it holds; html and body hold the page and are left out."""
    out = []
    for own, size, link, deep, lost, of in zip(*(x.to_pylist() for x in (tokens, chars, links, depths, gone, root)), strict=True):
        ends, around = _nested(deep, size)
        lost, run, links_ = set(lost or ()), [0], [0]
        for i, (c, n) in enumerate(zip(size, link, strict=True)):
            run.append(run[-1] + (0 if i in lost else abs(c) - n))
            links_.append(links_[-1] + (0 if i in lost else n))
        first: dict[int, int] = {}
        for i, t in enumerate(own):
            first.setdefault(t, i)
        rows = [{"token": None, "around": False, "running": run[-1], "links": links_[-1]}]
        for t in of:
            if t in first and not size[first[t]]:
                for up, i in ((False, first[t]), (True, around[first[t]])):
                    if i >= 0 and deep[i] >= 1:
                        rows.append({"token": t, "around": up, "running": run[ends[i]] - run[i], "links": links_[ends[i]] - links_[i]})
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("token", pa.int64()), ("around", pa.bool_()), ("running", pa.int64()), ("links", pa.int64())])))


@arrow_udf(SPAN)
def span_of(tokens: pa.Array, chars: pa.Array, depths: pa.Array, token: pa.Array, around: pa.Array) -> pa.Array:
    """The places from begin up to end of what the token's element, or the one around it, holds on the page; null without it."""
    out = []
    for own, size, deep, t, up in zip(*(x.to_pylist() for x in (tokens, chars, depths, token, around)), strict=True):
        i = own.index(t) if t is not None and t in own else -1
        if i >= 0:
            ends, outer = _nested(deep, size)
            i = outer[i] if up else i
        out.append({"begin": i, "end": ends[i]} if i >= 0 else None)
    return pa.array(out, pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


@arrow_udf(PARSED)
def parsed(htmls: pa.Array) -> pa.Array:
    """All tokens in order, with the characters of main blocks, those of other blocks below 0, and 0 for elements; of the main blocks their places among the tokens and their texts; whether the page marks them as such; and of
    each different token how often it stands there, its first and last place, and how many main blocks it is with how many characters. Counted here, a page's tokens needn't be shuffled to be counted.
    Besides, each token's depth and its characters in links, and the blocks that are no main ones, with whether tags set them aside."""
    tokens, chars, places, texts, marked, at, counts, depths, links, asides = [], [], [], [], [], [0], [[] for _ in COUNTED], [], [], []
    for html in htmls:
        own, blocks, deep = parse(html.as_py() or "")
        main = main_blocks(blocks)
        size, linked = [0] * len(own), [0] * len(own)
        for b in blocks:
            size[b.place], linked[b.place] = -len(b.text), b.linked
        for b in main:
            size[b.place] = len(b.text)
        tokens.append(own)
        depths.append(deep)
        links.append(linked)
        asides.append([{"place": b.place, "text": b.text, "aside": b.aside} for b in blocks if size[b.place] < 0])
        chars.append(size)
        places.append([b.place for b in main])
        texts.append([b.text for b in main])
        marked.append(any(b.article or b.main for b in main))
        seen: dict[int, list[int]] = {}
        for place, (token, c) in enumerate(zip(own, size, strict=True)):
            row = seen.setdefault(token, [0, place, place, 0, 0])
            row[0], row[2], row[3], row[4] = row[0] + 1, place, row[3] + (c > 0), row[4] + max(c, 0)
        at.append(at[-1] + len(seen))
        for values, new in zip(counts, [list(seen), *zip(*seen.values(), strict=True)] if seen else [[]] * len(counts), strict=True):
            values.extend(new)
    each = pa.StructArray.from_arrays([pa.array(v, pa.int64() if f.name == "token" else pa.int32()) for f, v in zip(COUNTED, counts, strict=True)], names=COUNTED.names)
    out = [pa.array(tokens, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string())), pa.array(marked, pa.bool_())]
    return pa.StructArray.from_arrays([*out, pa.ListArray.from_arrays(pa.array(at, pa.int32()), each), *[pa.array(v, pa.list_(pa.int32())) for v in (depths, links)], pa.array(asides, ASIDES)], names=PARSED.names)


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, gone): the places of each page's main blocks that belong to its host's template; (host, root): the root's tokens; (host, slots): the article's slots.

    pages has row, host, and what parsed() gives. No vector of a token's occurrences is ever gathered: a sum of hashes of
    (page, occurrences) stands for it, and tokens of equal sums are one class.
    """
    template, root, slots, shared = _deduced(pages)
    return _gone(shared, template, F.filter(_numbered("tokens", "chars"), lambda b: b["chars"] > 0)), root, slots


def _numbered(tokens: str, chars: str) -> Column:
    """A page's tokens with their places and characters."""
    return F.transform(F.arrays_zip(tokens, chars), lambda t, i: F.struct(i.alias("place"), t["tokens"].alias("token"), t["chars"].alias("chars")))


def _gone(shared: DataFrame, template: DataFrame, blocks: Column) -> DataFrame:
    """(row, gone): the places of those blocks of each page that belong to its host's template."""
    own = shared.select("host", "row", F.explode(blocks).alias("b")).select("host", "row", "b.*")
    return own.join(template, ["host", "token"]).groupBy("row").agg(F.collect_set("place").alias("gone"))


def _deduced(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(host, token): the tokens of each host's template; root and slots as in templates(); the pages of hosts that can have one."""
    pages = pages.where("host is not null and size(tokens) > 0")
    hosts = written(pages.groupBy("host").agg(F.count("*").alias("pages"), F.bool_or("marked").alias("marks")).where(F.col("pages") >= PAGES), "hosts")
    shared = pages.join(few(hosts), "host")
    counted = shared.select("host", "row", F.explode("counts").alias("c")).select("host", "row", "c.*")
    vector = F.sum(F.xxhash64("row", "n").cast("decimal(20,0)")).alias("vector")
    tokens = counted.groupBy("host", "token").agg(vector, F.count("*").alias("on")).where(F.col("on") >= PAGES)
    classes = tokens.groupBy("host", "vector", "on").agg(F.count("*").alias("size")).where(F.col("size") >= TOKENS)
    members = written(tokens.join(classes, ["host", "vector", "on"]).select("host", "token", "vector", "on", "size"), "members")
    found = counted.join(members.select("host", "token", "vector"), ["host", "token"])
    # each class on each page: its order, and the main text that it holds; shifted tokens stand for texts, so that sums fit
    spots = F.array_sort(F.collect_list(F.struct("first", "token")))
    on_page = found.groupBy("host", "row", "vector").agg(
        spots.alias("spots"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.shiftright("token", 24) * F.col("mains")).alias("said"), F.sum(F.nullif("chars", F.lit(0))).alias("chars"),
    )
    on_page = written(on_page, "classes")
    text = F.filter(F.arrays_zip("tokens", "chars"), lambda t: t["chars"] > 0)
    whole = shared.select(
        "row", F.aggregate(text, F.lit(0).cast("long"), lambda x, t: x + F.shiftright(t["tokens"], 24)).alias("all_said"), F.aggregate(text, F.lit(0).cast("long"), lambda x, t: x + t["chars"]).alias("all_chars"),
    )
    rest = on_page.groupBy("row").agg(F.sum("said").alias("shared")).join(whole, "row").select("row", "all_chars", (F.col("all_said") - F.col("shared")).alias("rest"))
    small = 2 * F.coalesce("chars", F.lit(0)) <= F.col("all_chars")
    kinds = on_page.select("host", "row", "vector", "chars").join(rest, "row").groupBy("host", "vector").agg(F.count_distinct("rest").alias("kinds"), F.count_distinct(F.when(small, F.col("rest"))).alias("nested_kinds"))
    kinds = written(kinds, "kinds")
    wide = members.select("host", "vector", "on", "size").distinct().join(kinds.where(F.col("kinds") >= PAGES), ["host", "vector"]).join(few(hosts), "host").where(2 * F.col("on") >= F.col("pages"))
    roots = written(wide.groupBy("host").agg(F.max_by("vector", F.struct("size", "on", "vector")).alias("vector")), "roots")
    root_at = on_page.join(few(roots), ["host", "vector"]).select("row", F.col("spots.first").alias("root_at"))
    # a root's tokens are all on one page, so they are no more than a page has
    root = written(members.join(few(roots), ["host", "vector"]).groupBy("host").agg(F.collect_list("token").alias("root")), "root")
    gap = on_page.join(root_at, "row", "left").join(few(roots.select("host", F.col("vector").alias("of_root"))), "host", "left").select(
        "host", "vector", F.coalesce(F.col("vector") == F.col("of_root"), F.lit(False)).alias("root"), F.xxhash64(F.transform("spots", lambda s: s["token"])).alias("order"),
        F.when(F.col("root_at").isNotNull(), F.size(F.filter("root_at", lambda p: p < F.col("first")))).alias("before"), F.when(F.col("root_at").isNotNull(), F.size(F.filter("root_at", lambda p: p <= F.col("last")))).alias("behind"),
    )
    kept = gap.groupBy("host", "vector").agg(
        F.min("order").alias("o0"), F.max("order").alias("o1"), F.bool_and("root").alias("root"),
        F.bool_and(F.col("before") == F.col("behind")).alias("nested"), F.min("before").alias("b0"), F.max("before").alias("b1"),
    ).join(kinds, ["host", "vector"]).where(f"o0 = o1 and (root or coalesce(nested and b0 = b1, true) and nested_kinds >= {PAGES})").select("host", "vector")
    template = members.select("host", "token", "vector").join(kept, ["host", "vector"]).select("host", "token")
    # the slots of the pages' blocks
    at = F.size(F.filter("root_at", lambda p: p <= F.col("place"))).alias("slot")
    voting = shared.where("marked or not marks").join(_few(root, "root"), "host").select("host", root_places("tokens", "root").alias("root_at"), "chars").where("root_at is not null")
    voting = voting.select("host", "root_at", F.posexplode("chars").alias("place", "chars")).where("chars <> 0")
    slots = voting.select("host", at, "chars").groupBy("host", "slot").agg(F.sum(F.col("chars").cast("long")).alias("chars")).where("chars > 0").groupBy("host").agg(F.collect_list("slot").alias("slots"))
    return template, root, slots, shared


def article_slots(shared: DataFrame, gone: DataFrame, root: DataFrame) -> DataFrame:
    """(host, token, around): the slot of each host's article by running text, for hosts where one slot has half of it; gone are the places of template blocks."""
    measured = shared.select("host", "row", "tokens", "chars", "links", "depths").join(_few(root, "root"), "host").join(gone, "row", "left")
    each = bounded_batches(measured).select("host", F.explode(slots_of("tokens", "chars", "links", "depths", "gone", "root")).alias("s")).select("host", "s.*")
    sums = written(each.groupBy("host", "token", "around").agg(F.sum("running").alias("running"), F.sum("links").alias("links")), "running")
    whole = sums.where("token is null").select("host", F.col("running").alias("whole"))
    wide = sums.where("token is not null").join(few(whole), "host").where("running > 0 and 2 * running >= whole")
    # no more than two slots a token of the root
    by_size = F.array_sort(F.collect_list(F.struct((F.col("running") + F.col("links")).alias("size"), "running", "links", "token", "around")))
    more = lambda now, s: 4 * (s["links"] - now["links"]) <= s["size"] - now["size"]
    best = F.aggregate("slots", F.element_at("slots", 1), lambda now, s: F.when(more(now, s), s).otherwise(now))
    return wide.groupBy("host").agg(by_size.alias("slots")).select("host", best.alias("s")).select("host", "s.token", "s.around")


def root_places(tokens: str, root: str) -> Column:
    """Where the root's tokens stand on a page, in order; null on a page without them. A page has all tokens of a class or none."""
    places = F.array_sort(F.transform(root, lambda t: F.array_position(tokens, t).cast("int") - 1))
    return F.when(F.array_contains(tokens, F.element_at(root, 1)), places)


def _few(df: DataFrame, column: str, most: int = 4 * MOST_SENT) -> DataFrame:
    """df with a hint to send it to every executor, if its rows and the elements of their arrays are no more than most (some 16 MB)."""
    size = df.agg(F.count("*").alias("n"), F.sum(F.size(column)).alias("m")).first()
    return F.broadcast(df) if size["n"] + (size["m"] or 0) <= most else df


def main_text(pages: DataFrame, parse_with=parsed) -> DataFrame:
    """page_id, url, text and n_chars, a row for each row of pages; parse_with is an expression on the html as parsed()."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    own = bounded_batches(pages).select("page_id", "url", F.when(host != "", host).alias("host"), parse_with("html").alias("p"))
    own = written(own.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "host", "p.*"), "pages")
    template, root, slots, shared = _deduced(own.drop("page_id", "url", "texts", "asides"))
    gone = written(_gone(shared, template, F.filter(_numbered("tokens", "chars"), lambda b: b["chars"] != 0)), "gone")
    article = written(article_slots(shared, gone, root), "article")
    gone, root, slots = _few(gone, "gone"), _few(root, "root"), _few(written(slots, "slots"), "slots")
    slot = lambda b: F.size(F.filter("root_at", lambda p: p <= b["place"]))
    in_slot = lambda b: F.col("root_at").isNull() | F.col("slots").isNull() | F.array_contains("slots", slot(b))
    is_gone = lambda b: F.coalesce(F.array_contains("gone", b["place"]), F.lit(False))
    joined = lambda blocks: F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")
    main = F.transform(F.arrays_zip("places", "texts"), lambda b: F.struct(b["places"].alias("place"), b["texts"].alias("text"), F.lit(False).alias("aside")))
    out = own.join(gone, "row", "left").join(root, "host", "left").join(slots, "host", "left").join(few(article), "host", "left")
    out = bounded_batches(out).withColumn("span", span_of("tokens", "chars", "depths", "token", "around")).withColumn("root_at", root_places("tokens", "root")).withColumn("main", main)
    inside = F.filter(F.array_sort(F.concat("main", "asides")), lambda b: (b["place"] >= F.col("span.begin")) & (b["place"] < F.col("span.end")) & ~is_gone(b))
    out = out.withColumn("inside", F.when(F.col("span").isNotNull(), inside)).select(
        "page_id", "url", F.array_join("texts", "\n").alias("whole"), joined(F.filter("main", lambda b: ~is_gone(b) & in_slot(b))).alias("voted"),
        joined(F.filter("inside", lambda b: ~b["aside"])).alias("text"), joined("inside").alias("all"),
    )
    out = out.select("page_id", "url", F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("text", "all")], F.when(F.col("text").isNull() & (F.col("voted") != ""), F.col("voted")), "whole").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
