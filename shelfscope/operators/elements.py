"""Pages as tables: one row per element of the markup, one per text, nested by intervals.

A page is cut into tokens, and a token's number is its place.  An element is the interval from its
opening tag to the token that ends it, so one element lies within another if its interval does.
Ends are found by running sums of opened and closed tags, over the tokens of one tag, and never by a
pattern that would have to nest: at equal depth an opening tag and the next closing one are a pair.
Elements that may go without closing tag (li, p, td and their like) are paired within the element
around them; the next one of their kind ends them, or the end of that element.

page_tables() finds the same rows with a stack by tag, page by page where the page lies: pages are
shuffled once, as texts, and no token is sorted; closing tags, comments and blanks are not kept.
tokens() and element_table() say the same in windows and are what it is tested against.  A page is
the unit of work, as it is for anybody who reads one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import checkpointed

VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Elements that may go without closing tag, by group; what begins a group, or one that ENDERS names, ends them.
GROUPS = {"li": "li", "p": "p", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option", "thead": "tbody", "tbody": "tbody", "tfoot": "tbody"}
ENDERS = {"td": ["tr", "tbody"], "tr": ["tbody"]}
#: Elements whose content is no markup; they are one token with all they hold.
RAW = "script style noscript template textarea svg".split()
_RAW = "|".join(rf"<{t}\b.*?</{t}\s*>" for t in RAW)
#: Comments, elements without markup inside, tags with quoted values, texts, and what is left over.
TOKEN = rf"(?is)<!--.*?-->|{_RAW}|<[a-z/!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]+|<"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&amp;": "&"}


def decoded(x: Column) -> Column:
    """The common character references decoded, white space collapsed."""
    for name, value in ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(x, r"[\s ]+", " "))


#: An opening tag up to one of its attributes.
_TO = r"(?is)^<[^\s>]+(?:\s+[^\s=>\"']+(?:\s*=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+)*?\s+"


def attribute(tag: Column, name: str) -> Column:
    """An attribute of an opening tag, quoted or not; empty if it has none."""
    pattern = rf"{_TO}{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    value = F.regexp_replace(F.regexp_extract(tag, pattern, 1), "^[\"']|[\"']$", "")
    return F.when(F.contains(F.lower(tag), F.lit(name.lower())), value).otherwise("")


def has_attribute(tag: Column, name: str) -> Column:
    return F.contains(F.lower(tag), F.lit(name.lower())) & F.regexp_like(tag, F.lit(rf"{_TO}{name}(?:[\s=/>])"))


def tokens(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """keys, pos, token, kind (open, close, single, text or none), tag; shuffled by keys."""
    cut = pages.select(*keys, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][^\s/>]*)", 1))
    single = tag.isin(VOID) | F.endswith("token", F.lit("/>")) | F.regexp_like("token", F.lit(rf"(?is)^<(?:{'|'.join(RAW)})\b.*</[a-z]+\s*>$"))
    kind = F.when((tag == "") & F.startswith("token", F.lit("<")) & (F.length("token") > 1), "none").when(tag == "", "text").when(F.startswith("token", F.lit("</")), "close").when(single, "single").otherwise("open")
    return cut.withColumns({"tag": tag, "kind": kind}).repartition(*keys)


def _paired(rows: DataFrame, by: list[str]) -> DataFrame:
    """Opening tags of ``rows`` with the place of the closing tag that pairs with them (null if none), among equal ``by``."""
    order = Window.partitionBy(*by).orderBy("pos")
    opened = F.sum(F.when(F.col("kind") == "open", 1).otherwise(-1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    level = Window.partitionBy(*by, "_level").orderBy("pos")
    rows = rows.withColumn("_level", opened + F.when(F.col("kind") == "close", 1).otherwise(0))
    rows = rows.withColumn("end", F.when(F.lead("kind").over(level) == "close", F.lead("pos").over(level)))
    return rows.where("kind = 'open'").drop("_level")


def innermost(rows: DataFrame, intervals: DataFrame, keys: list[str], name: str, depth: str | None = None) -> DataFrame:
    """``rows`` (keys, pos) with ``name``: the innermost interval (keys, pos, end) around each, as struct(pos, end); null if there is none.

    At one place an interval ends before rows are looked at, and begins after that, so none is around itself.
    ``depth`` names a column for the number of intervals around.
    """
    kept = [c for c in rows.columns if c not in (*keys, "pos")]
    blank = F.lit(None).cast("struct<pos:int,end:int>")
    payload = F.struct(*kept) if kept else F.struct(F.lit(0).alias("_none"))
    nothing = F.lit(None).cast(rows.select(payload.alias("x")).schema["x"].dataType)
    asked = rows.select(*keys, "pos", F.lit(1).alias("_ord"), F.lit(0).alias("_step"), blank.alias("_span"), payload.alias("_row"))
    opens = intervals.select(*keys, "pos", F.lit(2).alias("_ord"), F.lit(1).alias("_step"), F.struct("pos", "end").alias("_span"), nothing.alias("_row"))
    ends = intervals.select(*keys, F.col("end").alias("pos"), F.lit(0).alias("_ord"), F.lit(-1).alias("_step"), blank.alias("_span"), nothing.alias("_row"))
    order = Window.partitionBy(*keys).orderBy("pos", "_ord")
    both = asked.unionByName(opens).unionByName(ends).withColumn("_level", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    level = Window.partitionBy(*keys, "_level").orderBy("pos", "_ord").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn(name, F.last("_span", ignorenulls=True).over(level)).where("_ord = 1 and _row is not null")
    span = F.when(F.col(name)["end"] > F.col("pos"), F.col(name))
    return both.select(*keys, "pos", *[F.col(f"_row.{c}").alias(c) for c in kept], span.alias(name), *([F.col("_level").cast("int").alias(depth)] if depth else []))


def element_table(toks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, end, depth, parent (place of the element around it, null at the top), tag, token: one row per element."""
    pages_end = toks.groupBy(*keys).agg((F.max("pos") + 1).alias("_last"))
    tags = toks.where("kind in ('open', 'close')").select(*keys, "pos", "kind", "tag", "token")
    group = F.element_at(F.create_map(*[F.lit(v) for pair in GROUPS.items() for v in pair]), F.col("tag"))
    tags = tags.withColumn("_group", group)
    strict = _paired(tags.where("_group is null"), [*keys, "tag"])
    closed = strict.where("end is not null").select(*keys, "pos", "end")
    # Elements that were never closed end with the one around them.
    late = innermost(strict.where("end is null").drop("end"), closed, keys, "_in")
    loose = innermost(tags.where("_group is not null"), closed, keys, "_in").withColumn("_at", F.coalesce("_in.pos", F.lit(-1)))
    after = Window.partitionBy(*keys, "_at").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    begun = lambda g: F.min(F.when((F.col("kind") == "open") & (F.col("_group") == g), F.col("pos"))).over(after)
    nearest = [F.when(F.col("_group") == g, F.least(begun(g), *map(begun, ENDERS[g])) if g in ENDERS else begun(g)) for g in sorted(set(GROUPS.values()))]
    loose = loose.withColumn("_next", F.coalesce(*nearest))
    loose = _paired(loose, [*keys, "_at", "tag"]).withColumn("end", F.coalesce(F.col("end"), F.least("_next", "_in.end"))).drop("_next", "_at", "_in")
    every = strict.where("end is not null").unionByName(late.withColumn("end", F.col("_in.end")).drop("_in")).unionByName(loose)
    every = every.join(pages_end, keys).withColumn("end", F.coalesce("end", "_last").cast("int")).select(*keys, "pos", "end", "tag", "token")
    single = toks.where("kind = 'single'").select(*keys, "pos", F.col("pos").alias("end"), "tag", "token")
    placed = innermost(every.unionByName(single), every.select(*keys, "pos", "end"), keys, "_in", "depth")
    return placed.withColumn("parent", F.col("_in.pos")).drop("_in")


_CUT, _NAMED = re.compile(TOKEN, re.ASCII), re.compile(r"</?([a-zA-Z][^\s/>]*)", re.ASCII)
_WHOLE = re.compile(rf"<(?:{'|'.join(RAW)})\b.*</[a-z]+\s*>$", re.ASCII | re.IGNORECASE | re.DOTALL)
_ROWS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("pos", "end", "depth", "parent")] + [T.StructField(c, T.StringType()) for c in ("tag", "token")]))


def _around(ends: dict[int, int], n: int) -> tuple[list[tuple[int, int] | None], list[int]]:
    """The innermost interval (pos, end) around each place, as innermost() has it, and how many are open there."""
    closing, level, at, spans, depths = Counter(ends.values()), 0, {}, [], []
    for p in range(n):
        level -= closing.get(p, 0)
        span = at.get(level)
        spans.append(span if span and span[1] > p else None)
        depths.append(level)
        if p in ends:
            level += 1
            at[level] = (p, ends[p])
    return spans, depths


def _parsed(html: str) -> list[tuple]:
    """pos, end, depth, parent, tag, token of a page's elements, and of its texts with pos, tag and token only."""
    rows, open_, tagged, singles, texts = _CUT.findall(html), {}, [], [], []
    ends: dict[int, int] = {}
    n = len(rows)
    names = [""] * n
    for p, token in enumerate(rows):
        named = _NAMED.match(token) if token[0] == "<" else None
        if named is None:
            if (token[0] != "<" or token == "<") and token.strip(" \t\n\r\f\v"):
                texts.append(p)
            continue
        tag = names[p] = named[1].lower()
        if token.startswith("</"):
            if tag in GROUPS:
                tagged.append((p, False))
            elif open_.get(tag):
                ends[open_[tag].pop()] = p
        elif tag in VOID or token.endswith("/>") or (tag in RAW and _WHOLE.match(token)):
            singles.append(p)
        elif tag in GROUPS:
            tagged.append((p, True))
        else:
            open_.setdefault(tag, []).append(p)
    around, _ = _around(ends, n)
    late = {p: around[p][1] if around[p] else n for ps in open_.values() for p in ps}
    # Elements that may go without closing tag: within the element around them.
    pending: dict[tuple, list[int]] = {}
    loose: dict[int, int] = {}
    for p, opens in tagged:
        waiting = pending.setdefault((around[p] and around[p][0], names[p]), [])
        if opens:
            waiting.append(p)
        elif waiting:
            loose[waiting.pop()] = p
    begun: dict[tuple, int] = {}
    for p, opens in reversed(tagged):
        if opens:
            group, of = GROUPS[names[p]], around[p] and around[p][0]
            if p not in loose:
                loose[p] = min([begun.get((of, g), n) for g in (group, *ENDERS.get(group, ()))] + [around[p][1] if around[p] else n])
            begun[of, group] = p
    every = ends | late | loose
    around, depths = _around(every, n)
    found = [(p, e, depths[p], around[p][0] if around[p] else None, names[p], rows[p]) for p, e in [*every.items(), *((p, p) for p in singles)]]
    return sorted(found + [(p, None, None, None, "", rows[p]) for p in texts])


@F.arrow_udf(_ROWS)
def _page_rows(html: pa.Array) -> pa.Array:
    kind = pa.struct([("pos", pa.int32()), ("end", pa.int32()), ("depth", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("token", pa.string())])
    parts = []
    for k in range(0, len(html), 256):  # so that few pages' rows are Python objects at a time
        pages = [_parsed(x or "") for x in html.slice(k, 256).to_pylist()]
        offsets = [0]
        for rows in pages:
            offsets.append(offsets[-1] + len(rows))
        columns = list(zip(*[row for rows in pages for row in rows], strict=True)) or [()] * len(kind)
        values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
        parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))


def page_rows(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """keys, pos, end, depth, parent, tag, token: elements as in element_table(), and texts, whose end is null; rows stay where they are."""
    return pages.select(*keys, F.inline(_page_rows(F.col(html_col))))


def elements_of(rows: DataFrame) -> DataFrame:
    return rows.where("end is not null")


def page_tables(pages: DataFrame, keys: list[str], html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """tokens() but closing tags, comments and blanks, and element_table() of pages; one table, shuffled by keys and written once for all that reads them."""
    rows = checkpointed(page_rows(pages.select(*keys, html_col).repartition(*keys), keys, html_col))
    kind = F.when(F.col("end").isNull(), "text").when(F.col("end") == F.col("pos"), "single").otherwise("open")
    return rows.select(*keys, "pos", "token", kind.alias("kind"), "tag"), elements_of(rows)


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once a row, however often they are used; withColumn() would repeat them within what uses them."""
    return rows.select(*[c for c in rows.columns if c not in columns], F.inline(F.array(F.struct(*[x.alias(name) for name, x in columns.items()]))))


def _element(r: Column) -> Column:
    cls = attribute(r["token"], "class")
    return F.struct(*[r[c].alias(c) for c in ("pos", "end", "depth", "parent", "tag", "token")], cls.alias("cls"), F.split(F.lower(cls), r"\s+").alias("classes"))


def page_arrays(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with els and texts in place of their html: elements (as in element_table(), with their class and classes) and texts (pos, text) that are not blank.

    What is asked of them is asked within the row of the page, so nothing is shuffled, joined or written.
    """
    rows = held(pages.withColumn("_rows", _page_rows(F.col(html_col))).drop(html_col), _rows=F.col("_rows"))
    texts = F.transform(F.filter("_rows", lambda r: r["end"].isNull()), lambda r: F.struct(r["pos"].alias("pos"), decoded(r["token"]).alias("text")))
    return held(rows, els=F.transform(F.filter("_rows", lambda r: r["end"].isNotNull()), _element), texts=F.filter(texts, lambda t: t["text"] != "")).drop("_rows")


def gathered(toks: DataFrame, els: DataFrame, keys: list[str]) -> DataFrame:
    """keys, els, texts as page_arrays() has them, out of the tables of pages."""
    named = els.select(*keys, F.struct("pos", "end", "depth", "parent", "tag", "token").alias("_e"))
    both = named.unionByName(text_table(toks, keys).select(*keys, F.struct("pos", "text").alias("_t")), allowMissingColumns=True)
    rows = both.groupBy(*keys).agg(F.array_sort(F.collect_list("_e")).alias("_els"), F.array_sort(F.collect_list("_t")).alias("texts"))
    return held(rows, els=F.transform("_els", _element)).drop("_els")


def span(x: Column) -> Column:
    return F.struct(x["pos"].alias("pos"), x["end"].alias("end"))


def first(items: Column | str, test: Callable[[Column], Column] | None = None) -> Column:
    """The first of ``items`` that passes; null if none does."""
    return F.get(F.filter(items, test) if test else items, F.lit(0))


def inside(items: Column, around: Column) -> Column:
    """Those of ``items`` that begin within an interval."""
    return F.filter(items, lambda x: (x["pos"] > around["pos"]) & (x["pos"] < around["end"]))


def innermost_of(spans: Column, pos: Column) -> Column:
    """The innermost of ``spans`` around a place; null if there is none."""
    return F.array_max(F.filter(spans, lambda s: (s["pos"] < pos) & (s["end"] > pos)))


def text_inside(texts: Column, around: Column) -> Column:
    """The texts within an interval, in order, joined by blanks; empty if there are none."""
    return F.array_join(F.transform(inside(texts, around), lambda t: t["text"]), " ")


def has_one(e: Column, names: list[str]) -> Column:
    """has_class() of an element of page_arrays()."""
    return F.arrays_overlap(e["classes"], F.array(*map(F.lit, names)))


def holds_one(e: Column, parts: list[str]) -> Column:
    """class_holds() of an element of page_arrays()."""
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(e["cls"]), p))


def text_table(toks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, text: texts that are not blank, decoded and trimmed."""
    texts = toks.where("kind = 'text'").select(*keys, "pos", decoded(F.col("token")).alias("text"))
    return texts.where("text <> ''")


def texts_within(spans: DataFrame, texts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``spans`` (keys, pos, end) with ``name``: the texts within each, in order, joined by blanks; empty if there are none."""
    inner = texts.select(*keys, F.col("pos").alias("_at"), F.col("text").alias("_text"))
    found = spans.select(*keys, "pos", "end").join(inner, keys).where("_at > pos and _at < end").groupBy(*keys, "pos").agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_all"))
    joined = found.select(*keys, "pos", F.array_join(F.transform("_all", lambda x: x["_text"]), " ").alias(name))
    return spans.join(joined, [*keys, "pos"], "left").withColumn(name, F.coalesce(name, F.lit("")))


def has_class(token: Column, names: list[str]) -> Column:
    """Whether one of the classes of an opening tag is one of the names."""
    return F.arrays_overlap(F.split(F.lower(attribute(token, "class")), r"\s+"), F.array(*map(F.lit, names)))


def class_holds(token: Column, parts: list[str]) -> Column:
    """Whether the class attribute of an opening tag holds one of the parts."""
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(attribute(token, "class")), p))
