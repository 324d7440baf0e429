"""Benchmark decontamination with built-in functions only.

Test texts become windows of normalised words: the hash set that is broadcast. A document is split into words once, and
the hash of the whole window at each position is looked up in a bitmap of the set's hashes, within the row. Only the
positions that pass leave the row, each with its window; they probe the set and are verified word by word. Then words,
spans or documents are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import materialise, row_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_WINDOWS = 1_000_000   # beyond it the windows are joined by a shuffle
BITS_A_WINDOW, MAX_BITS = 64, 1 << 22   # of the bitmap; more windows let more positions pass, all are verified


def normal_words(text: F.Column) -> F.Column:
    """Words of the text with A-Z lower-cased (other letters stay as they are)."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.char_length(t)
    lowered = F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """(win, items, win_id): distinct windows with the ids of the items that have them."""
    w = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), normal_words(F.col("text")).alias("w"))
         .where(F.size("w") > 0))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    one = w.select("item_id", "w", F.explode(starts).alias("at")).select(
        "item_id", F.slice("w", F.col("at") + 1, size).alias("win"))
    return one.groupBy("win").agg(F.collect_set("item_id").alias("items")).select("win", "items", F.xxhash64("win").alias("win_id"))


def _bitmap(windows: DataFrame, count: int) -> tuple[int, F.Column]:
    """(bits, array of 32 bits each) of the windows' hashes. At most MAX_BITS / 32 numbers reach the driver."""
    bits = 1 << 6
    while bits < min(MAX_BITS, BITS_A_WINDOW * count):
        bits *= 2
    at = F.pmod("win_id", F.lit(bits))
    found = windows.groupBy(F.shiftright(at, 5).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(win_id, {bits}) AS INT) & 31)")).alias("v"))
    cells = [0] * (bits // 32)
    for r in found.collect():
        cells[r["cell"]] = r["v"]
    return bits, F.expr("array(" + ",".join(f"{c}L" for c in cells) + ")")


def candidates(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, int]:
    """docs(row_key, text, ...) -> the other columns, n_words, cand: array of (pos, win) of the positions whose window's hash
    may be a test window's; and the number of windows. Words are made once, in the row."""
    rest = [c for c in docs.columns if c != "text"]
    sizes = {r[0]: r[1] for r in windows.groupBy(F.size("win")).count().collect()}  # at most a window's size of rows
    count = sum(sizes.values())
    words = docs.select(*rest, normal_words(F.col("text")).alias("words"))
    if not count:
        none = F.array().cast("array<struct<pos:int,win:array<string>>>")
        return words.select(*rest, F.size("words").cast("long").alias("n_words"), none.alias("cand")), 0
    bits, cells = _bitmap(windows, count)

    def passes(window: F.Column) -> F.Column:
        at = F.pmod(F.xxhash64(window), F.lit(bits)).cast("int")
        return F.get(cells, F.shiftright(at, 5)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(31))) != 0

    def of_size(k: int) -> F.Column:
        starts = F.when(F.size("words") >= k, F.sequence(F.lit(0), F.size("words") - k)).otherwise(F.array().cast("array<int>"))
        hits = F.filter(starts, lambda i: passes(F.slice("words", i + 1, k)))
        return F.transform(hits, lambda i: F.struct(i.alias("pos"), F.slice("words", i + 1, k).alias("win")))

    return words.select(*rest, F.size("words").cast("long").alias("n_words"), F.concat(*[of_size(k) for k in sorted(sizes)]).alias("cand")), count


def find_windows(found: DataFrame, windows: DataFrame, count: int) -> DataFrame:
    """Rows of ``candidates`` (row_key, cand) x windows -> (row_key, pos, end, win_id): verified occurrences."""
    at = found.where(F.size("cand") > 0).select("row_key", F.explode("cand").alias("c"))
    at = at.select("row_key", F.col("c.pos").alias("pos"), F.col("c.win").alias("seen"), F.xxhash64("c.win").alias("win_id"))
    hits = at.join(F.broadcast(windows) if count <= BROADCAST_WINDOWS else windows.hint("merge"), "win_id")
    return hits.where(F.col("seen") == F.col("win")).select("row_key", "pos", (F.col("pos") + F.size("win")).alias("end"), "win_id")


def contamination(found: DataFrame, windows: DataFrame, count: int) -> DataFrame:
    """Rows of ``candidates`` x windows -> (row_key, n_hit, spans, items) for
    the documents with a hit; ``spans`` are the sorted word ranges, ``items`` the ids found."""
    hits = find_windows(found, windows, count)
    one = hits.groupBy("row_key", "win_id").agg(F.collect_set(F.struct("pos", "end")).alias("s"))
    # one row per document and window; a document's ranges and items are bounded by its own words
    per = one.join(windows.select("win_id", "items"), "win_id").groupBy("row_key").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["pos"], a["reach"]))).alias("n"),
            F.greatest(a["reach"], s["end"]).alias("reach")), lambda a: a["n"])
    return per.select("row_key", covered.alias("n_hit"), "spans", "items")


def document_report(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or blank texts have no words and no hit; a benchmark text with fewer words than a window, but some, is
    one window; repeated benchmark rows count once and one without an id marks words but is no item.
    Rows that share a doc_id are judged each by its own text. Extra columns are ignored."""
    windows = materialise(windows_of(benchmark, size), "windows")
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row_key"), "text")
    rows, count = candidates(numbered, windows)
    base = materialise(rows, "scanned")     # without texts; the numbers hold from here on
    found = contamination(base.select("row_key", "cand"), windows, count)
    base = base.select("doc_id", "row_key", "n_words")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return base.join(found, "row_key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "documents") -> DataFrame:
    """Documents without their hits, all columns kept: ``documents`` drops every document with a
    hit, ``spans`` keeps the document with the words outside hits (normalised, one space apart). Null or blank texts have
    no hit and stay; repeated rows are judged alike; an empty benchmark removes nothing; input columns may have any names."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    key = row_key(F.col("doc_id"), F.col("text")).alias("row_key")
    windows = materialise(windows_of(benchmark, size), "windows")
    rows, count = candidates(docs.select(key, "text"), windows)
    found = contamination(materialise(rows.select("row_key", "cand"), "scanned"), windows, count)
    keyed = docs.select(key, F.struct(*docs.columns).alias("row"))
    if remove == "documents":
        return keyed.join(found, "row_key", "left_anti").select("row.*")
    merged = keyed.join(found.select("row_key", "spans"), "row_key", "left").withColumn("words", normal_words(F.col("row.text")))
    kept = F.filter("words", lambda w, i: ~F.exists("spans", lambda s: (s["pos"] <= i) & (i < s["end"])))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(kept, " "))
    return merged.select(*[(text if c == "text" else F.col(f"row.{c}")).alias(c) for c in docs.columns])
