"""Document fingerprints: SimHash from weighted term votes, and block tables that find near fingerprints.

A term is a pair of neighbouring words (a text of one word: that word), lower-cased; every occurrence
votes with its length in code points, so that long, telling pairs outweigh pairs of short function
words.  Each of the fingerprint's bits is 1 where the votes for 1 outweigh those against.  The votes
are plain sums: exploded terms are summed per document inside the scan's task (two 32-bit counters
share a long), and only the sums of a document travel.

``within_radius`` finds fingerprints at most ``radius`` bits apart: the bits are cut into blocks, and
two fingerprints that differ in at most ``radius`` of them agree on all but ``radius`` blocks.  For
each choice of the blocks that agree there is a table keyed by them ("permuted"); the number of blocks
is chosen so that a key has about as many bits as the count of fingerprints, hence few false
candidates; a key that many fingerprints share all the same is refined by blocks of its other bits.

Cases: null text is the empty text, whose fingerprint is all zeros; equal texts have equal
fingerprints; the document after the last is the first; a null id comes after all ids in descending
order; where an id repeats, each of its rows has its own result, and the document before takes the
smallest of its texts' beginnings and the smallest of its fingerprints as the next one's; other columns are not looked at; an empty table
gives an empty table.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.core import attach
from airgrid.llm.common import SPACE, SPACE_RUN, hot_join, text_or_empty, written
from airgrid.llm.row_numbers import numbered

#: 64-bit words of a fingerprint
WORDS = 2
#: entries under one key of a table beyond which the key is refined
CROWDED = 64
_LANES = 0x0000000100000001
#: a null id is the last one in descending order
_NO_ID = -(1 << 63)


def votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per distinct ``keys``: the bit sums, packed in pairs, and the total weight."""
    words = F.split(F.btrim(F.lower(F.col(text)), F.lit(SPACE)), SPACE_RUN)
    term = lambda a, b: F.struct((F.char_length(a) + F.char_length(b)).cast("long").alias("w"), F.xxhash64(a, b).alias("h"))
    split = rows.select(*keys, words.alias("_ws"))
    ws = F.col("_ws")
    pairs = F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(1))), lambda a, b: F.when(b.isNotNull(), term(a, b)))
    terms = F.when(F.size(ws) > 1, pairs).otherwise(F.array(term(ws[0], F.lit(""))))
    exploded = split.select(*keys, F.explode(terms).alias("t")).select(*keys, F.col("t.w").alias("_w"), F.col("t.h").alias("_h0"))
    exploded = exploded.withColumns({f"_h{i}": F.xxhash64("_h0", F.lit(i)) for i in range(1, WORDS)})
    lane = lambda i, j: F.shiftrightunsigned(F.col(f"_h{i}"), j).bitwiseAND(F.lit(_LANES)) * F.col("_w")
    sums = [F.sum(lane(i, j)).alias(f"_s{i}_{j}") for i in range(WORDS) for j in range(32)]
    return exploded.groupBy(*keys).agg(F.sum("_w").alias("_w"), *sums)


def _word(i: int) -> Column:
    """Word i of a fingerprint from its packed sums: bit j and bit j + 32 share a long."""
    bit = lambda v, j: F.when(v * 2 > F.col("_w"), F.lit(1 << j if j < 63 else -(1 << 63))).otherwise(F.lit(0))
    out = F.lit(0).cast("long")
    for j in range(32):
        s = F.col(f"_s{i}_{j}")
        out = out.bitwiseOR(bit(s.bitwiseAND(F.lit(0xFFFFFFFF)), j)).bitwiseOR(bit(F.shiftrightunsigned(s, 32), j + 32))
    return out


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, fp0, fp1, ...): the fingerprint's words for each distinct ``keys``."""
    return votes(rows, keys, text).select(*keys, *[_word(i).alias(f"fp{i}") for i in range(WORDS)])


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Number of differing bits."""
    return reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)])


def likeness(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """The cosine that the share of differing bits stands for, 0 where it would be negative."""
    return F.greatest(F.lit(0.0), F.round(F.cos(distance(a, b) * F.lit(math.pi / (64 * WORDS))), 9))


def as_hex(words: Sequence[Column]) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words]))


def _next_documents(text: DataFrame) -> DataFrame:
    """(id, before, need): the document that ``id`` follows, and how many characters that one takes of it."""
    needs = text.select("id", F.floor(F.char_length("text") / 3).cast("int").alias("need")).groupBy("id").agg(F.max("need").alias("need"))
    placed, n = numbered(needs, [F.col("id").desc()])
    after = placed.select(F.pmod(F.col("row") + 1, F.lit(max(n, 1))).alias("row"), F.col("id").alias("before"), "need")
    return written(placed.select("row", "id").join(after, "row").drop("row"), "next-documents")


def fingerprint_pairs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", asked: Column | None = None, radius: int = 3
) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near) per row of ``docs``.

    A text's edited form has its last third (in code points, rounded down) replaced by as many code
    points from the beginning of the next document, in descending order of ids.
    """
    text = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), text_or_empty(text_col).alias("text"))
    plan = _next_documents(text)
    # texts are dealt by id once, for both joins; only the beginnings move again
    heads = text.join(plan, "id").select(F.col("before").alias("id"), F.left("text", F.col("need")).alias("head"))
    heads = heads.groupBy("id").agg(F.min("head").alias("head"))
    size = F.char_length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.left(F.col("text"), size - third), F.left(F.col("head"), third))
    rows = text.join(heads, "id").select("id", "text", size.cast("long").alias("n_chars"), edited.alias("edited"))
    sides = rows.withColumn("row", F.monotonically_increasing_id()).select(
        "id", "row", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"),
        F.posexplode(F.array("text", "edited")).alias("side", "text"),
    )
    row = ["id", "row", "n_chars", "sha"]
    prints = fingerprints(sides, [*row, "side"], "text")
    side = lambda s: [F.max(F.when(F.col("side") == s, F.col(f"fp{i}"))).alias(f"{'ab'[s]}{i}") for i in range(WORDS)]
    wide = written(prints.groupBy(*row).agg(*side(0), *side(1)), "fingerprints")

    a, b, c = ([F.col(f"{x}{i}") for i in range(WORDS)] for x in "abc")
    least = wide.groupBy("id").agg(F.min(F.struct(*a)).alias("fp"))
    following = least.join(plan, "id").select(F.col("before").alias("id"), *[F.col("fp")[f"a{i}"].alias(f"c{i}") for i in range(WORDS)])
    rows = wide.join(following, "id").withColumn("n_near", F.lit(None).cast("long"))
    if asked is not None:
        known = F.when(F.col("id") != _NO_ID, F.col("id"))
        own = wide.select(F.col("row").alias("_row"), known.alias("id"), *[F.col(f"a{i}").alias(f"fp{i}") for i in range(WORDS)])
        searched = own.where(asked).drop("id").withColumnRenamed("_row", "id")
        counts = neighbour_counts(searched, own.drop("id").withColumnRenamed("_row", "id"), radius)
        rows = rows.drop("n_near").join(counts.withColumnRenamed("query_id", "row"), "row", "left")
    return rows.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias(id_col), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        as_hex(a).alias("fingerprint"), as_hex(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), "n_near",
    )


def block_count(n: int, radius: int) -> int:
    """Blocks of which all but ``radius`` have about log2(n) bits, one at least."""
    bits, blocks = 64 * WORDS, radius + 1
    while bits * (blocks - radius) / blocks < math.log2(max(n, 2)) and blocks < bits:
        blocks += 1
    return blocks


def _mask(positions: Sequence[int]) -> list[int]:
    """The given bits, as signed words."""
    bits = sum(1 << p for p in positions)
    parts = [(bits >> (64 * i)) & ((1 << 64) - 1) for i in range(WORDS)]
    return [p - (1 << 64) if p >> 63 else p for p in parts]


def _choices(blocks: int, radius: int) -> list[tuple[list[int], list[list[int]]]]:
    """Per table: the mask of the blocks that agree, and the masks of ``radius + 1`` parts of the other bits."""
    bits = 64 * WORDS
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    out = []
    for agree in itertools.combinations(range(blocks), blocks - radius):
        chosen = [p for i in agree for p in range(edges[i], edges[i + 1])]
        other = sorted(set(range(bits)) - set(chosen))
        out.append((_mask(chosen), [_mask(other[j :: radius + 1]) for j in range(radius + 1)]))
    return out


def _tables(rows: DataFrame, blocks: int, radius: int) -> DataFrame:
    """One row per table and fingerprint: the key is what the table's agreeing blocks hold."""
    words = [F.col(f"fp{i}") for i in range(WORDS)]
    held = lambda mask: [w.bitwiseAND(F.lit(m)) for w, m in zip(words, mask, strict=True)]
    keys = [F.xxhash64(F.lit(t), *held(mask)) for t, (mask, _) in enumerate(_choices(blocks, radius))]
    return rows.select("*", F.posexplode(F.array(*keys)).alias("_table", "_key"))


def _refined(rows: DataFrame, crowded: DataFrame, n: int, blocks: int, radius: int) -> DataFrame:
    """Crowded keys made longer by one part each of the table's other bits; near fingerprints share a part at least."""
    masks = F.array(*[F.array(*[F.array(*map(F.lit, m)) for m in parts]) for _, parts in _choices(blocks, radius)])
    longer = F.transform(
        F.get(masks, F.col("_table")),
        lambda m, j: F.xxhash64(F.col("_key"), j, *[F.col(f"fp{i}").bitwiseAND(F.get(m, F.lit(i))) for i in range(WORDS)]),
    )
    keys = F.when(F.col("_entries").isNotNull(), longer).otherwise(F.array("_key"))
    return hot_join(rows, crowded, ["_key"], "_entries", n, "left").withColumn("_key", F.explode(keys)).drop("_table", "_entries")


def near_prints(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """(fp0, fp1, id, distance, copies): the distinct fingerprints at most ``radius`` bits from each distinct one asked for.

    Equal fingerprints are one entry in the tables, however many documents have them.  A key under which
    more than ``CROWDED`` entries stand is refined by further blocks, on both sides alike; pairs
    are compared inside the join, so that only near ones leave it.
    """
    words = [f"fp{i}" for i in range(WORDS)]
    entries = prints.groupBy(*words).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    entries = written(entries, "distinct-fingerprints")
    n = entries.count()
    blocks = block_count(n, radius)
    n *= math.comb(blocks, radius)
    right, left = _tables(entries, blocks, radius), _tables(queries.select(*words).distinct(), blocks, radius)
    crowded = right.groupBy("_key").agg(F.count(F.lit(1)).alias("_entries")).where(F.col("_entries") > CROWDED)
    crowded = written(crowded, "crowded-keys")
    right = _refined(right, crowded, n, blocks, radius)
    left = _refined(left, crowded, n, blocks, radius).withColumnsRenamed({w: f"q{w}" for w in words}).withColumnRenamed("_key", "_asked")
    apart = distance([F.col(w) for w in words], [F.col(f"q{w}") for w in words])
    near = left.join(right, (F.col("_asked") == F.col("_key")) & (apart <= radius)).withColumn("distance", apart)
    near = near.groupBy(*[f"q{w}" for w in words], "id").agg(F.max("distance").alias("distance"), F.max("copies").alias("copies"))
    return near.withColumnsRenamed({f"q{w}": w for w in words})


def within_radius(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """(query_id, id, distance, copies): the distinct fingerprints at most ``radius`` bits from each query's.

    Both inputs have ``id, fp0, fp1``; ``id`` stands for the smallest id of a fingerprint's ``copies``.
    """
    words = [f"fp{i}" for i in range(WORDS)]
    near = written(near_prints(queries, prints, radius), "near-fingerprints")
    return attach(queries.select(F.col("id").alias("query_id"), *words), near, words).drop(*words)


def neighbour_counts(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """(query_id, n_near): how many other rows of ``prints``, which hold the queries', are at most ``radius`` bits away."""
    words = [f"fp{i}" for i in range(WORDS)]
    totals = near_prints(queries, prints, radius).groupBy(*words).agg((F.sum("copies") - 1).alias("n_near"))
    asked = queries.groupBy(*words).agg(F.count(F.lit(1)).alias("_asked"))
    totals = written(totals.join(asked, words), "near-counts")
    rows = queries.select(F.col("id").alias("query_id"), *words)
    return hot_join(rows, totals, words, "_asked", queries.count()).select("query_id", "n_near")
