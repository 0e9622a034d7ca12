"""Benchmark decontamination by template windows, with DataFrame functions only.

Numbers, names and units become typed placeholders, so a question whose values were
exchanged keeps its template. Windows of template tokens are hash-joined with those of
the benchmark, and so are windows with names as lower-case words, for copies in another
case. Slots of a match must be consistent: where an item repeats a value, the document
must repeat the value that it has in its place. Every capitalised word has a slot, but
one that is no name in its item has to be the same in the document. Long texts are taken
in pieces that overlap, so no row grows with the length of a text once it is in tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import marked, written

WINDOW = 8
#: Windows of each width that begin in a piece of a text; it has the tokens that they end in too.
PIECE = 1024
#: Share of an item's windows that a document must hold, or tokens in a row, whatever the item's length.
COVERAGE, RUN = 0.3, 13
#: Items from this many tokens on are looked for inside longer texts; shorter ones are a document or nothing.
SHORT = 3
#: Items whose windows one task makes.
ITEMS_PART = 500
#: Benchmark windows up to this number are broadcast (16 MB or so); more are shuffled, with what a bit filter of them lets pass.
BROADCAST_WINDOWS = 200_000
# Units that follow a number.
UNITS = (
    "mm cm dm m km mg g kg t ml cl dl l s sec min h hr hrs ms inch inches in ft feet yd mi mile miles lb lbs oz "
    "meter meters metre metres gram grams liter liters litre litres second seconds minute minutes hour hours "
    "day days week weeks month months year years percent dollar dollars euro euros cent cents"
).split()
SLOT = "\u0001"
INSIDE = "\u0002"
#: Names are slots in the first kind of hashes and words in the second.
KINDS = ("typed", "plain")
INSIDE_SENTENCE = r"(?<=[\p{Ll},;] )"


def template_tokens(text: str) -> Column:
    """Lower-case words; a slot is a mark, its type (n, p, q or u) and its value.

    Numbers may have separators inside; p is a capitalised word inside a sentence (behind
    a lower-case one or a comma), q one elsewhere; a unit follows a number.
    """
    s = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{SLOT}{INSIDE}]", " ")
    s = F.regexp_replace(s, r"(?<=\p{Nd})[.,:/](?=\p{Nd})", INSIDE)
    s = F.regexp_replace(s, rf"(?<![\p{{L}}\p{{Nd}}{INSIDE}])(\p{{Nd}}[\p{{Nd}}{INSIDE}]*)", f" {SLOT}n$1 ")
    s = F.regexp_replace(s, rf"({SLOT}n\S+\s+)((?i:{'|'.join(UNITS)}))(?![\p{{L}}\p{{Nd}}])", f"$1{SLOT}u$2")
    s = F.regexp_replace(s, rf"{INSIDE_SENTENCE}(\p{{Lu}}\p{{Ll}}+)", f"{SLOT}p$1")
    s = F.regexp_replace(s, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{M}}\p{{Nd}}{SLOT}])", f"{SLOT}q")
    s = F.trim(F.regexp_replace(F.lower(s), rf"[^\p{{L}}\p{{M}}\p{{Nd}}{SLOT}{INSIDE}]+", " "))
    return F.array_remove(F.split(s, " "), "")


def _is_slot(token: Column) -> Column:
    return F.substring(token, 1, 1) == SLOT


def _is_name(token: Column) -> Column:
    return F.substring(token, 1, 2).isin(f"{SLOT}p", f"{SLOT}q")


def _word(token: Column) -> Column:
    return F.when(_is_slot(token), F.substr(token, F.lit(3))).otherwise(token)


def _hashes(tokens: str, names: bool) -> Column:
    """Hashes of the tokens, slots by type only; names as slots or as lower-case words."""
    name = F.lit(f"{SLOT}p") if names else None
    slot = lambda t: F.when(_is_name(t), F.substr(t, F.lit(3)) if name is None else name).otherwise(F.substring(t, 1, 2))
    return F.transform(tokens, lambda t: F.xxhash64(F.when(_is_slot(t), slot(t)).otherwise(t)))


def _tokens(df: DataFrame, row: str, text: str, prefix: str) -> DataFrame:
    """Id, tokens of the text, their number and the place of the first: the text in one piece."""
    tokens = f"{prefix}_tokens"
    rows = df.select(F.col(row).cast("long").alias(f"{prefix}_id"), template_tokens(text).alias(tokens))
    return rows.select("*", F.size(tokens).alias(f"{prefix}_n"), F.lit(0).alias(f"{prefix}_begin"))


def _pieces(rows: DataFrame, prefix: str) -> DataFrame:
    """The same rows with ``PIECE`` tokens of a text in each, and those of the next piece that windows end in.

    Windows take some hundred bytes a token, so a long text as a whole would take as much
    of a task's memory as it likes. The outer form of explode keeps Spark from testing
    the places below, which would make the tokens twice.
    """
    tokens, n, begin = f"{prefix}_tokens", f"{prefix}_n", f"{prefix}_begin"
    places = F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)), F.lit(PIECE))
    rows = rows.select(f"{prefix}_id", tokens, n, F.explode_outer(places).alias(begin))
    return rows.withColumn(tokens, F.slice(tokens, F.col(begin) + 1, PIECE + WINDOW - 1))


def _hashed(rows: DataFrame, prefix: str) -> DataFrame:
    """``rows`` with, for both kinds, hashes of the tokens and of ``WINDOW`` from each on.

    Hashes of two, four and eight tokens are made of each other; the last ones, which
    lack tokens, are not read.
    """
    given, tokens = rows.columns, f"{prefix}_tokens"
    rows = rows.select("*", _hashes(tokens, True).alias("typed1"), _hashes(tokens, False).alias("plain1"))
    half = 1
    while half < WINDOW:
        wider = lambda c: F.transform(c, lambda x, i: F.xxhash64(x, F.get(c, i + half)))  # noqa: B023, E731
        made = [wider(f"{k}{half}").alias(f"{k}{2 * half}") for k in KINDS]
        rows = rows.select(*given, *(f"{k}1" for k in KINDS), *made)
        half *= 2
    return rows


def _whole_short(prefix: str) -> Column:
    return F.col(f"{prefix}_n").between(1, SHORT - 1)


def _n_windows(prefix: str, width: int, most: int | None) -> Column:
    """How many windows of ``width`` tokens begin in a row, ``most`` at most; 0 stands for a whole text of under ``SHORT``."""
    if width == 0:
        return _whole_short(prefix).cast("int")
    n = F.greatest(F.size(f"{prefix}_tokens") - width + 1, F.lit(0))
    return n if most is None else F.least(n, F.lit(most))


def _windows(prefix: str, kind: str, width: int, most: int | None) -> Column:
    """Hashes of all windows of ``width`` tokens that begin in a row, in order."""
    one, n = f"{kind}1", _n_windows(prefix, width, most)
    none = F.array().cast("array<bigint>")
    if width == 0:
        return F.when(_whole_short(prefix), F.array(F.xxhash64(one))).otherwise(none)
    if width == WINDOW:
        return F.slice(f"{kind}{WINDOW}", F.lit(1), n)
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    return F.when(n > 0, F.transform(at, lambda i: F.xxhash64(*(F.get(one, i + k) for k in range(width))))).otherwise(none)


def _exploded(rows: DataFrame, prefix: str, widths: list[int], most: int | None = None) -> DataFrame:
    """One row per window and kind: id, tokens of the piece and its place, place in the text, hash and width.

    The outer form of explode keeps Spark from testing the windows for emptiness below,
    which would work them out twice; a text without any gives a null that joins nothing.
    """
    parts = [(k, w) for w in (WINDOW, 0, *widths) for k in KINDS]
    given, n = rows.columns, F.col(f"{prefix}_n")
    rows = _hashed(rows, prefix)
    rows = rows.select(*given, F.posexplode_outer(F.concat(*(_windows(prefix, *p, most) for p in parts))).alias("pos", "window"))
    begin, at, width = F.lit(0), F.lit(None), F.lit(None)
    for _, w in parts:
        at = F.when(F.col("pos") >= begin, F.col("pos") - begin).otherwise(at)
        width = F.when(F.col("pos") >= begin, F.lit(w) if w else n).otherwise(width)
        begin = begin + _n_windows(prefix, w, most)
    at = F.col(f"{prefix}_begin") + at
    return rows.select(*(c for c in given if c != f"{prefix}_n"), at.alias(f"{prefix}_at"), "window", width.alias(f"{prefix}_width"))


def _part(width: Column) -> Column:
    """``width`` tokens of a document from a window's place on."""
    return F.slice("doc_tokens", F.col("doc_at") - F.col("doc_begin") + 1, width)


def _found(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Windows of documents with those of items that have the same hash, and ``doc_part``, the document's tokens.

    Where the items' windows are too many to broadcast, a bit filter of them is: only
    windows that pass it are shuffled, and with their own tokens only.
    """
    if items.count() <= BROADCAST_WINDOWS:
        return windows.join(F.broadcast(items), "window").withColumn("doc_part", _part(F.col("width")))
    windows = marked(windows, "window", items, "window").where("_maybe")
    found = windows.select("doc_id", "doc_at", "window", _part(F.lit(WINDOW)).alias("doc_part")).join(items, "window")
    return found.withColumn("doc_part", F.slice("doc_part", F.lit(1), F.col("width")))


def _run_starts(at: Column) -> Column:
    """Places of the sorted ``at`` from which windows in a row make ``RUN`` tokens."""
    more = RUN - WINDOW
    return F.filter(at, lambda x, i: F.coalesce(F.get(at, i + more) == x + more, F.lit(False)))


def _marked(tokens: str) -> Column:
    """A word with the mark p inside a sentence has it everywhere in its text."""
    inside = F.transform(F.filter(tokens, lambda t: F.substring(t, 1, 2) == f"{SLOT}p"), _word)
    known = lambda t: F.array_contains(inside, F.substr(t, F.lit(3)))
    return F.transform(
        tokens, lambda t: F.when((F.substring(t, 1, 2) == f"{SLOT}q") & known(t), F.concat(F.lit(f"{SLOT}p"), F.substr(t, F.lit(3)))).otherwise(t)
    )


def _names_only(hits: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``hits`` without those that exchange a common word of the documents.

    ``doubt`` has the item's words that are capitalised only where a sentence may begin and
    that the document has another word for. One that more documents write in lower case
    than capitalised inside a sentence is no name. Documents are read for this only if
    there is any such word.
    """
    words = written(hits.select(F.explode("doubt").alias("word")).distinct(), "words")
    if words.isEmpty():
        return hits
    body = F.coalesce(F.col(text), F.lit(""))
    lower = F.array_distinct(F.split(body, r"[^\p{L}\p{M}]+"))
    inner = F.array_distinct(F.regexp_extract_all(body, F.lit(rf"{INSIDE_SENTENCE}\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}]*"), F.lit(0)))
    seen = docs.select(F.explode(lower).alias("word"), F.lit(1).alias("sign")).union(
        docs.select(F.explode(inner).alias("word")).select(F.lower("word"), F.lit(-1))
    )
    seen = seen.join(F.broadcast(words), "word") if words.count() <= BROADCAST_WINDOWS else seen.join(words, "word")
    common = written(seen.groupBy("word").agg(F.sum("sign").alias("more")).where("more > 0").select("word"), "words")
    key = ["doc_id", "item_id", "shift", "item_at"]
    wrong = hits.select(*key, F.explode("doubt").alias("word")).join(common, "word", "left_semi").select(*key, F.lit(True).alias("doubted"))
    same_key = [F.col(f"h.{k}").eqNullSafe(F.col(f"w.{k}")) for k in key]
    # a hit without doubts at the same place stays: it is the window with names as words
    doubtful = hits.where(F.size("doubt") > 0).alias("h").join(wrong.distinct().alias("w"), same_key, "left_anti")
    return hits.where(F.size("doubt") == 0).union(doubtful)


def _classes(benchmark: DataFrame, item_id: str) -> DataFrame:
    """``own_id, item_id, texts``: every item with its different texts, and the least item that has just these.

    Items of the same texts are found in the same documents, so one of them is looked for.
    """
    rows = benchmark.select(F.col(item_id).cast("long").alias("own_id"), "text")
    texts = rows.groupBy("own_id").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    return texts.withColumn("item_id", F.min("own_id").over(Window.partitionBy("texts")))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """``doc_id, item_id, windows, item_windows, coverage, exchanged``: documents that hold an item.

    A document holds an item by ``COVERAGE`` of its windows or by ``RUN`` tokens in a row.
    ``windows`` counts the different windows of the item that the document holds at
    places where the slots are consistent, or that are a verbatim run; ``exchanged``
    tells that some slot has another value. An item of fewer than ``WINDOW`` tokens is
    one window, found inside longer texts too; one of fewer than ``SHORT`` is found only
    as a whole document of as many words. Null and empty texts hold nothing and are in
    nothing. Rows that repeat an id count as one document or item; a null id is one more
    id. Other columns are ignored.
    """
    classes = written(_classes(benchmark, item_id), "classes")
    texts = classes.where(F.col("own_id").eqNullSafe(F.col("item_id"))).select("item_id", F.explode("texts").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.repartition(min(parts, 1 + classes.count() // ITEMS_PART))  # the benchmark may be one file
    texts = _tokens(texts, "item_id", "text", "item")
    short = texts.where(F.col("item_n").between(SHORT, WINDOW - 1)).select("item_n").distinct()
    widths = sorted(r["item_n"] for r in short.collect())
    items = _exploded(texts, "item", widths).where("window is not null")
    # an item has windows of one width only: its own where it is short
    n = F.size("item_tokens")
    items = items.where(F.col("item_width") == F.least(n, F.lit(WINDOW))).withColumn("item_tokens", _marked("item_tokens"))
    items = items.select(
        "item_id", F.col("item_width").alias("width"), (n - F.col("item_width") + 1).alias("item_windows"), "item_at", "window",
        F.slice("item_tokens", F.col("item_at") + 1, F.col("item_width")).alias("item_part"),
    )
    # equal windows of rows that repeat an item id would only multiply the matches
    items = items.groupBy("item_id", "window", "item_at").agg(
        F.max("item_windows").alias("item_windows"), F.max("width").alias("width"), F.max("item_part").alias("item_part")
    )
    items = written(items, "items")
    windows = _exploded(_pieces(_tokens(docs, doc_id, text, "doc"), "doc"), "doc", widths, PIECE)
    found = _found(windows, items)
    pairs = F.filter(F.arrays_zip(F.col("item_part").alias("item"), F.col("doc_part").alias("doc")), lambda x: _is_slot(x["item"]))
    slots = F.transform(pairs, lambda x: F.struct(x["item"].alias("item"), _word(x["doc"]).alias("doc"), _word(x["item"]).alias("own")))
    other = F.filter("slots", lambda x: x["own"] != x["doc"])
    doubt = F.transform(F.filter(other, lambda x: F.substring(x["item"], 1, 2) == f"{SLOT}q"), lambda x: x["own"])
    hits = found.select(
        F.col("doc_id"), "item_id", "item_windows", "item_at", (F.col("doc_at") - F.col("item_at")).alias("shift"),
        slots.alias("slots"),
    ).withColumns({"same": F.size(other) == 0, "doubt": F.array_distinct(doubt)})
    hits = _names_only(written(hits, "hits"), docs, text)
    # places per alignment of a document and an item, and the values of each slot there
    place = ["doc_id", "item_id", "shift"]
    per_slot = (
        hits.select(*place, "item_windows", "item_at", "same", F.explode_outer("slots").alias("slot"))
        .groupBy(*place, F.col("slot.item").alias("item"), F.col("slot.own").alias("value"))
        .agg(
            F.max("item_windows").alias("item_windows"),
            F.min("slot.doc").alias("least"),
            F.max("slot.doc").alias("most"),
            F.collect_set("item_at").alias("at"),
            F.collect_set(F.when(F.col("same"), F.col("item_at"))).alias("same_at"),
        )
    )
    steady = (
        per_slot.groupBy(*place)
        .agg(
            F.max("item_windows").alias("item_windows"),
            F.max(F.coalesce(F.col("least") != F.col("most"), F.lit(False))).alias("contradicts"),
            F.max(F.coalesce(F.col("least") != F.col("value"), F.lit(False))).alias("exchanged"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("same_at")))).alias("same_at"),
        )
    )
    # of an alignment that contradicts itself only verbatim runs are left
    in_runs = F.array_distinct(F.flatten(F.transform(_run_starts(F.col("same_at")), lambda x: F.sequence(x, x + (RUN - WINDOW)))))
    steady = steady.select(
        "doc_id", "item_id", "item_windows", (F.col("exchanged") & ~F.col("contradicts")).alias("exchanged"),
        F.when(F.col("contradicts"), in_runs).otherwise(F.col("at")).alias("at"),
    )
    steady = steady.withColumn("run", F.size(_run_starts(F.col("at"))) > 0)
    per_window = steady.select("doc_id", "item_id", "item_windows", "exchanged", "run", F.explode("at").alias("item_at"))
    per_window = per_window.groupBy("doc_id", "item_id", "item_at").agg(
        F.max("item_windows").alias("item_windows"), F.min("exchanged").alias("exchanged"), F.max("run").alias("run")
    )
    out = per_window.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("windows"), F.max("item_windows").cast("long").alias("item_windows"), F.max("exchanged").alias("exchanged"),
        F.max("run").alias("run"),
    )
    coverage = F.col("windows") / F.col("item_windows")
    out = out.where((coverage >= COVERAGE) | F.col("run")).withColumn("coverage", coverage)
    out = out.alias("f").join(classes.select("item_id", "own_id").alias("c"), F.col("f.item_id").eqNullSafe(F.col("c.item_id")))
    return out.select("doc_id", F.col("own_id").alias("item_id"), "windows", "item_windows", "coverage", "exchanged")
