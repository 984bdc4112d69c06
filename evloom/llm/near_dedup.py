"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full shingle sets, components.

How links are found without listing all pairs of a group:

1. Documents with equal shingle sets become one; banding puts the distinct sets into buckets.
2. In every bucket the members are compared with one leader, the set with the largest company over all
   buckets. The centre of a crowd of near copies leads all its buckets, so this needs about one
   comparison per member. Every comparison is made on the full shingle sets.
3. The links found are closed to components. Buckets inside one component are settled: more links there
   change nothing. In the others, members of different components are compared by bottom-k sketches in
   blocks of bounded size. The sketch of a small set is the set, so only pairs that reach the threshold,
   or for large sets may reach it, leave a block; they are then compared on their full sets.

A link at the threshold of 0.85 is missed with a probability of about 6e-11 by the banding and 1e-6 by
the sketches of large sets; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.llm.hashing import mix, word_hashes
from evloom.llm.tables import bounded_batches, slices, written
from evloom.operators.primitives import connected_components

_STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLOCK = 512
_SKETCH = 256


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles of each text; a shorter text is one shingle."""
    owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for documents, found, _ in word_hashes(texts):
        owners.append(documents)
        hashes.append(found)
    flat = np.concatenate(hashes)
    bounds = np.searchsorted(np.concatenate(owners), np.arange(len(texts) + 1))
    n = max(0, len(flat) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += flat[k:k + n] * _FACTORS[k]
    rolled = mix(rolled)
    sets = []
    for start, end in zip(bounds[:-1], bounds[1:]):
        if end - start >= words:
            sets.append(np.unique(rolled[start:end - words + 1]))
        else:
            own = flat[start:end]
            sets.append(mix((own * _FACTORS[:len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own))) if len(own) else own)
    return sets


def super_minhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``size`` values per (non-empty) set.

    Every element draws a permutation of the slots by Fisher-Yates steps; in step j it offers the value
    j + fraction to the slot drawn then. The ranks of one element thus differ in every slot, which
    lowers the variance against independent hashes. A set stops as soon as all its slots hold values below the next
    step. All elements of all sets take a step together; the permutation is not stored, its j-th entry
    is traced back through the earlier draws.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    values = np.full(len(sets) * size, _EMPTY)
    draws: list[np.ndarray] = []
    for j in range(size):
        if not len(element):
            break
        random = mix(element + np.uint64((j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        drawn = j + ((random & np.uint64(0xFFFFFFFF)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int16)
        slot = drawn.copy()
        for i in range(j - 1, -1, -1):
            slot[slot == draws[i]] = i
        np.minimum.at(values, owner * size + slot, (np.uint64(j) << np.uint64(32)) | (random >> np.uint64(32)))
        going = values.reshape(-1, size).max(1) >= np.uint64(j + 1) << np.uint64(32)
        if not going.all():
            stay = going[owner]
            owner, element = owner[stay], element[stay]
            draws = [d[stay] for d in draws]
            drawn = drawn[stay]
        draws.append(drawn)
    return values.reshape(-1, size)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of consecutive signature values; the band's number is part of the key."""
    rows = signatures.shape[1] // bands
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(signatures), 1))
    for k in range(rows):
        keys = mix(keys ^ signatures[:, k::rows][:, :bands])
    return keys


def _described(docs: DataFrame, words: int, size: int, bands: int) -> DataFrame:
    """(__id, __n, __a, __b, __bands, __sketch): set size, two set digests, band keys and smallest hashes of every document."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column(1).to_pylist(), words)
                some = [s for s in sets if len(s)]
                keys = iter(band_keys(super_minhash(some, size), bands).view(np.int64).tolist())
                digests = [[mix(s ^ f).sum(dtype=np.uint64).astype(np.int64).item() if len(s) else None for s in sets] for f in _FACTORS[-2:]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(d, pa.int64()) for d in digests),
                     pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                     pa.array([(s[:_SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary())],
                    ["__id", "__n", "__a", "__b", "__bands", "__sketch"])

    return docs.mapInArrow(describe, f"__id {docs.schema['__id'].dataType.simpleString()}, __n bigint, __a bigint, __b bigint, __bands array<bigint>, __sketch binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= ``percent`` * union."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sides = [c.to_pylist() for c in part.columns]
                other = list(dict.fromkeys(sides[3]))  # leaders repeat
                right = dict(zip(other, shingle_sets(other, words)))
                keep = []
                for left, text in zip(shingle_sets(sides[2], words), sides[3]):
                    same = len(np.intersect1d(left, right[text], assume_unique=True))
                    keep.append(100 * same >= percent * (len(left) + len(right[text]) - same))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in part.columns[:2]], ["a", "b"])

    kind = texts.schema["__id"].dataType.simpleString()
    left = texts.select(F.col("__id").alias("a"), F.col("__text").alias("__left"))
    right = texts.select(F.col("__id").alias("b"), F.col("__text").alias("__right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "__left", "__right")
    return both.mapInArrow(compare, f"a {kind}, b {kind}")


def sketch_pairs(sketches: list[bytes], sizes: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray | None,
                 percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of different components that reach ``percent``, or may reach it where a sketch is not the whole set.

    ``right`` None compares ``left`` with itself. A sketch holds the smallest hashes of a set; below
    the smaller of two largest hashes both sketches are complete, which gives the estimate.
    """
    arrays = [np.frombuffer(s, "<u4") for s in sketches]
    words, at = np.unique(np.concatenate(arrays), return_inverse=True)
    place = np.full((len(arrays), _SKETCH), len(words))  # padding points behind the last word
    for row, (a, b) in enumerate(zip(np.cumsum([0, *map(len, arrays)]), np.cumsum([0, *map(len, arrays)])[1:])):
        place[row, :b - a] = at[a:b]
    whole = sizes <= _SKETCH
    top = np.where(whole, len(words), place.max(axis=1, initial=0, where=place < len(words)))
    mark = np.zeros(len(words) + 1, bool)
    slack = 4.75 * (percent / 100 * (1 - percent / 100) / _SKETCH) ** 0.5
    found = []
    for n, i in enumerate(left):
        others = left[n + 1:] if right is None else right
        others = others[component[others] != component[i]]
        if not len(others):
            continue
        mark[place[i]] = True
        mark[len(words)] = False
        same = np.count_nonzero(mark[place[others]], axis=1)
        mark[place[i]] = False
        limit = np.minimum(top[i], top[others])
        own = np.searchsorted(place[i][place[i] < len(words)], limit, side="right")
        theirs = np.count_nonzero((place[others] <= limit[:, None]) & (place[others] < len(words)), axis=1)
        union = np.maximum(own + theirs - same, 1)
        # short hashes that coincide can only add to what is shared, so whole sets lose nothing
        reached = np.where(whole[i] & whole[others], 100 * same >= percent * union, same >= (percent / 100 - slack) * union)
        found += [(i, j) for j in others[reached]]
    return found


def _similar_in_blocks(members: DataFrame, kind: str, percent: int) -> DataFrame:
    """Pairs (a, b) of a block whose components differ and whose sketches may reach the threshold.

    ``members``: __k, __lo, __hi, __side, __c, __rep, __n, __sketch; a block holds about two times ``_BLOCK`` rows at most.
    """
    def block(part: pa.Table) -> list[tuple[int, int]]:
        side, component = part["__side"].to_numpy(), part["__c"].to_numpy()
        within = part["__lo"][0].as_py() == part["__hi"][0].as_py()
        left = np.arange(len(side)) if within else np.flatnonzero(side == side.min())
        right = None if within else np.flatnonzero(side != side.min())
        return sketch_pairs(part["__sketch"].to_pylist(), part["__n"].to_numpy(), component, left, right, percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in _then_none(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                waiting = table if waiting is None else pa.concat_tables([waiting, table]).combine_chunks()
            if waiting is None or not len(waiting):
                continue
            key = np.stack([waiting[c].to_numpy() for c in ("__k", "__lo", "__hi")], 1)
            starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
            done = starts if batch is None else starts[:-1]  # the last block may go on in the next batch
            rows = [(i + a, j + a) for a, b in zip(done[:-1], done[1:]) if b - a > 1 for i, j in block(waiting.slice(a, b - a))]
            if rows:
                left, right = (waiting["__rep"].take(pa.array(x, pa.int64())).combine_chunks() for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([left, right], ["a", "b"])
            waiting = waiting.slice(done[-1])

    ordered = members.repartition("__k", "__lo", "__hi").sortWithinPartitions("__k", "__lo", "__hi")
    return ordered.select("__k", "__lo", "__hi", "__side", "__c", "__rep", "__n", "__sketch").mapInArrow(compare, f"a {kind}, b {kind}")


def _then_none(items):
    yield from items
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    percent: int = 85, size: int = 128, bands: int = 32) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked where 100 * |intersection| >= ``percent`` * |union| of their distinct ``words``-word
    shingles (A-Z as a-z; a shorter text is one shingle). ``component_id`` is the smallest id that
    links reach; ``kept`` marks the document that has it.

    Null or empty texts have no shingles and are linked with nothing. Rows with a null id are linked
    with nothing, have a null component and are kept. Rows that share an id are one node: a link of
    one counts for all. Repeated rows, equal texts and extra columns need no care. An empty table gives
    an empty table.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    described = written(_described(source, words, size, bands), "shingles")
    usable = described.where(F.col("__id").isNotNull() & (F.col("__n") > 0))
    sets = written(usable.groupBy("__a", "__b").agg(F.min("__id").alias("__rep"), F.first("__bands").alias("__bands")), "sets")
    keys = sets.select("__rep", F.explode("__bands").alias("__k"))
    buckets = written(keys.groupBy("__k").agg(F.count("*").alias("__m")).where("__m > 1"), "buckets")
    live = written(keys.join(buckets, "__k"), "members")
    crowd = live.groupBy("__rep").agg(F.sum("__m").alias("__crowd"))
    leaders = written(live.join(crowd, "__rep").groupBy("__k").agg(F.max_by("__rep", F.struct("__crowd", "__rep")).alias("b")), "leaders")
    pairs = live.join(leaders, "__k").where(F.col("__rep") != F.col("b")).select(F.col("__rep").alias("a"), "b").distinct()
    links = written(_confirmed(pairs, source, words, percent), "links")

    near = connected_components(links, "a", "b").select(F.col("node").alias("__rep"), F.col("component").alias("__c"))
    placed = written(live.join(near, "__rep", "left").select("__k", "__m", "__rep", F.coalesce("__c", "__rep").alias("__c")), "placed")
    unsettled = written(placed.groupBy("__k").agg(F.min("__c").alias("__x"), F.max("__c").alias("__y")).where("__x <> __y").select("__k"), "unsettled")
    blocks = F.ceil(F.col("__m") / _BLOCK).cast("int")
    side = F.pmod(F.xxhash64("__rep"), blocks).cast("int")
    members = (placed.join(unsettled, "__k").join(usable.select(F.col("__id").alias("__rep"), "__n", "__sketch"), "__rep")
               .withColumn("__side", side).withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
               .select("__k", F.least("__side", "__other").alias("__lo"), F.greatest("__side", "__other").alias("__hi"),
                       "__side", F.xxhash64("__c").alias("__c"), "__rep", "__n", "__sketch"))
    more = written(_similar_in_blocks(members, kind, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    more_links = _confirmed(more, source, words, percent)

    own = described.join(sets.select("__a", "__b", "__rep"), ["__a", "__b"], "left")
    own = written(own.select("__id", "__n", F.when(F.col("__id").isNotNull(), F.col("__rep")).alias("__rep")), "owners")
    several = own.where("__rep IS NOT NULL").groupBy("__id").agg(F.min("__rep").alias("b"), F.max("__rep").alias("__z")).where("b <> __z").drop("__z")
    same_id = own.join(several, "__id").where(F.col("__rep") != F.col("b")).select(F.col("__rep").alias("a"), "b")
    final = connected_components(links.unionByName(more_links).unionByName(same_id), "a", "b")
    final = written(final.select(F.col("node").alias("__rep"), F.col("component").alias("__c")), "components")
    component = F.when(F.col("__id").isNotNull(), F.coalesce("__c", "__rep", "__id"))
    return (own.join(final, "__rep", "left").withColumn("component_id", component)
            .select(F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"), "component_id",
                    F.col("__id").eqNullSafe(F.col("component_id")).alias("kept")))
