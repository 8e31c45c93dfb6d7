"""Benchmark decontamination with built-in expressions only.

The hashes of all windows of the benchmark's normalised words, one long each, go to all tasks while there are at most
``MAX_BROADCAST`` of them (some 130 MB); beyond that the same join is left to a shuffle, of which adaptive execution
splits a hash that very many documents hold. Documents are parted into words once, whatever lengths the windows have,
and stream their window hashes past the set; only hits leave that stage. A hit counts once the document's words there
equal the window's, so a clash of hashes never does. For that the texts of documents with hits are read again; no other
text is moved while these documents are few enough to be named to all tasks (``common.MAX_SENT``).

Null or empty texts have no words and no hits; items without words have no window. An item shorter than the window is
one window of its own length. A null item_id is skipped in the item list but its windows hit. Null doc_ids and
repeated rows: each row comes back once with its own verdict. Empty tables give empty results or no hits. A very long
text is one row: a task holds its words, a hash for each and, where it is verified, its hits. Extra
columns pass through ``decontaminate``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keyed, let, restored, sent_if_small, settle, slim, text_of

WINDOW = 10
MAX_BROADCAST = 2_000_000
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def norm_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAP), "")


def _window_hash(w: Column, i: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)])


def _window_hashes(w: Column, n: int) -> Column:
    return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(0))), lambda _, i: _window_hash(w, i, n))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, len, win (words), h of each window of each item, once."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), norm_words(text_of()).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - F.col("len"))
    rows = w.withColumn("len", F.least(F.size("w"), F.lit(window))).select("item_id", "len", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.col("len")))).alias("win")).distinct()
    h = reduce(lambda rest, n: F.when(F.col("len") == n, _window_hash(F.col("win"), F.lit(0), n)).otherwise(rest), range(1, window + 1), F.lit(None).cast("bigint"))
    return rows.withColumn("h", h)


def window_hits(docs: DataFrame, windows: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """_k, _v, pos, len, h where a document's window hash is one of ``windows`` (len, win, h; each once). Not verified."""
    lengths = sorted(r.len for r in windows.select("len").distinct().collect())  # at most as many as the window has words
    if not lengths:
        return docs.select("_k", "_v").limit(0).withColumns({"pos": F.lit(0), "len": F.lit(0), "h": F.lit(0).cast("bigint")})
    hashes = windows.select("h").distinct()
    if windows.count() <= max_broadcast:
        hashes = F.broadcast(hashes)
    of_all = let(norm_words(text_of()), lambda w: F.array(*[F.struct(F.lit(n).alias("len"), _window_hashes(w, n).alias("hs")) for n in lengths]))
    rows = docs.select("_k", "_v", F.inline(of_all)).select("_k", "_v", "len", F.posexplode("hs").alias("pos", "h"))
    return rows.join(hashes, "h").select("_k", "_v", "pos", "len", "h")  # the length is part of the hash


def _covered(hits: Column) -> Column:
    """Words in the union of [pos, pos + len)."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(x["pos"], a["end"]))).alias("n"), F.greatest(a["end"], x["pos"] + x["len"]).alias("end"))
    return F.aggregate(F.sort_array(hits), zero, step, lambda a: a["n"])


def verified_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """_k, _v, hits (sorted array of pos, len, win) of each document of ``docs`` (as ``keyed`` gives it) that has any; the item windows. Both settled."""
    own = settle(item_windows(items, window), "item-windows")
    wins = own.select("len", "win", "h").distinct()
    found = settle(window_hits(docs, wins), "window-hits")
    named = sent_if_small(settle(found.select("_k", "_v").distinct(), "hit-documents"))
    texts = docs.join(named, ["_k", "_v"], "left_semi").dropDuplicates(["_k", "_v"]).select("_k", "_v", norm_words(text_of()).alias("w"))
    per_doc = found.join(wins, ["len", "h"]).groupBy("_k", "_v").agg(F.collect_set(F.struct("pos", "len", "win")).alias("found"))
    true = F.sort_array(F.filter("found", lambda x: F.slice("w", x["pos"] + 1, x["len"]) == x["win"]))
    return settle(texts.join(per_doc, ["_k", "_v"]).select("_k", "_v", true.alias("hits")).where(F.size("hits") > 0), "hits"), own


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), items_sha256, contaminated."""
    d = keyed(docs.select("doc_id", "text"))
    found, own = verified_hits(d, items, window)
    wins = found.select("_k", "_v", F.explode(F.array_distinct(F.transform("hits", lambda x: x["win"]))).alias("win"))
    # Sets of ids combine before the shuffle.
    listed = wins.join(own.select("win", "item_id").where("item_id is not null"), "win").groupBy("_k", "_v").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    per_doc = settle(found.select("_k", "_v", _covered(F.col("hits")).alias("n_hit")).join(listed, ["_k", "_v"], "left"), "contamination")
    out = d.select("doc_id", "_k", "_v", F.size(norm_words(text_of())).cast("bigint").alias("n_words")).join(sent_if_small(per_doc, 1 + F.coalesce(F.size("item_ids"), F.lit(0))), ["_k", "_v"], "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("bigint")), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "item_ids")


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "document", window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated documents (mode "document") or without the words that are hit (mode "span")."""
    if mode not in ("document", "span"):
        raise ValueError(f"mode {mode!r}")
    d = keyed(slim(docs))
    found, _ = verified_hits(d, items, window)
    if mode == "document":
        return restored(d.join(sent_if_small(settle(found.select("_k", "_v"), "contaminated")), ["_k", "_v"], "left_anti"), docs.columns)
    spans = settle(found.select("_k", "_v", F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))).alias("hit")), "hit-words")
    both = d.join(sent_if_small(spans, F.size("hit")), ["_k", "_v"], "left")
    said = F.regexp_extract_all(text_of(), F.lit(f"({WORD})"), F.lit(1))
    # Gap 0, then each word (unless hit) with the gap behind it. Hits as a map: one look-up for each word.
    gaps = F.split(text_of(), WORD)
    lost = let(F.map_from_arrays("hit", F.transform("hit", lambda _: F.lit(True))), lambda m: let(gaps, lambda g: F.concat(F.get(g, F.lit(0)), F.array_join(F.transform(said, lambda x, i: F.concat(F.when(F.try_element_at(m, i).isNull(), x).otherwise(""), F.get(g, i + 1))), ""))))
    return both.withColumn("text", F.when(F.col("hit").isNull(), F.col("text")).otherwise(lost)).transform(restored, docs.columns)
