"""Near-duplicates by bottom-k sketches of word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, map_in_arrow, stash
from .words import Words, slices

#: Size of a sketch, and the overlap that sketches of linked texts must have: at similarity 0.8 a shared part of 77 of 96
#: is expected, and 54 or less has a probability of 1.1e-7 (binomial tail). Sets up to 96 are compared whole.
SKETCH, OVERLAP = 96, 55
#: Least share of the union's sketch for a pair to be compared in full; the same tail.
ESTIMATE = OVERLAP / SKETCH
#: Places of the bitmap of rows whose text is wanted again.
PLACES = 1 << 23
#: Hubs of a list that are compared with all its rows, by turn; the last goes on until the list is done. From turn 1 on
#: these come from outside the list's largest component, and CENTRES more from inside it.
HUBS, CENTRES = (1, 16, 1024, 65536), 4


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, rows = Words(texts, lower=True).ngrams(words, short=True)
    ends = np.searchsorted(rows, np.arange(len(texts) + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield np.unique(hashes[a:b])


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """128 bits that equal sets share, as two columns."""
    found = b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
    both = np.frombuffer(found, np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    if ends[-1] >= 1 << 31:
        raise ValueError("a slice of texts has too many shingles for one batch")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))


def _sketches(words: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column("text"), words))
                columns = [part.column("doc_id"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()), *_digests(sets), _lists([s[:SKETCH] for s in sets])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_shingles", "d1", "d2", "sketch"])

    return run


def _full_sets(words: int, bits: np.ndarray):
    def run(batches):
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column("text"), words))
                yield pa.RecordBatch.from_arrays([*_digests(sets), _lists(sets)], ["d1", "d2", "shingles"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity: the union's sketch first, then the full sets."""
    low, high = x[:SKETCH], y[:SKETCH]
    union = np.union1d(low, high)[:SKETCH]
    if np.isin(union, np.intersect1d(low, high, assume_unique=True), assume_unique=True).sum() < ESTIMATE * len(union):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            sides = []
            for name in ("sa", "sb"):
                column = batch.column(name)
                sides.append((column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()))
            (x, xs), (y, ys) = sides
            keep = [similar(x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]], percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bits(ids: DataFrame) -> np.ndarray:
    """Which of the 2**23 hash values of ``doc_id`` occur: 1 MB at any size. When most bits are set it just lets more rows pass."""
    words = ids.select(_place().alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = np.zeros(PLACES >> 6, np.int64)
    for row in words.collect():
        out[row["w"]] = row["bits"]
    return out.view(np.uint64)


def _place():
    return F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest label reachable from each node: nodes (node, label), edges (a, b) → nodes with new labels.

    Labels hook onto their smallest neighbour and skip two hooks at once;
    repeated until no edge joins two labels.
    """
    while True:
        left = edges.join(nodes.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
        both = left.join(nodes.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la != lb")
        hooks = stash(both.groupBy(F.greatest("la", "lb").alias("label")).agg(F.min(F.least("la", "lb")).alias("to")), "near-hooks")
        if hooks.isEmpty():
            return nodes
        far = hooks.select(F.col("label").alias("to"), F.col("to").alias("beyond"))
        far = hooks.join(far, "to", "left").select("label", F.coalesce("beyond", "to").alias("to"))
        nodes = stash(nodes.join(far, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "near-labels")


def _rare_first(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """Inverted lists: values (cls, v), sizes (cls, n, k, need) → rows (v, cls, n, at, far) of lists with two or more
    classes.

    A class of ``k`` values that must share ``need`` of them with any partner
    enters the lists of its first ``k - need + 1`` values, those in the fewest
    classes first, ties by value. Any two classes that can be linked share one
    of these, since the order is the same for all. ``at`` is the value's place
    in that order, ``far`` how many of a million values no other class has:
    these come first and make no list.
    """
    shared = stash(values.groupBy("v").agg(F.count("cls").alias("df")).where("df > 1"), "near-counts")
    own = values.join(shared, "v").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    own = own.join(sizes, "cls").withColumn("room", (F.size("vs") - F.col("need") + 1).cast("int")).where("room > 0")
    first = own.select("cls", "n", "k", (F.col("k") - F.size("vs")).alias("alone"), F.posexplode(F.slice("vs", F.lit(1), F.col("room"))).alias("i", "x"))
    lists = stash(first.select("x.v", "cls", "n", (F.col("alone") + F.col("i")).alias("at"), F.floor(F.col("alone") * 1_000_000 / F.col("k")).alias("far")), "near-lists")
    several = lists.groupBy("v").agg(F.count("*").alias("m")).where("m > 1").select("v")
    kept = stash(lists.join(several, "v"), "near-lists")
    discard(lists)
    discard(shared)
    return kept


def near_duplicates(documents: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """Link rows (doc_id, text) whose sets of ``words``-word shingles have a Jaccard similarity of ``percent`` or more.

    1. Each text becomes its distinct shingle hashes; the smallest SKETCH of
       them are its sketch. Equal sets (by 128 bits) are one class from here.
    2. Inverted lists of the retained values, rarest first: sketches that
       overlap enough share one of these, and what is common in the corpus
       makes no long lists. A class in no list has no partner.
    3. The others enter lists by their full sets, in the same way: no link can
       be lost here, and a class whose own words take the room meets nobody.
    4. In each list the class with the smallest share of values of its own is
       compared with all others; what it gathers is one component. Then lists
       that still hold several components compare members outside the largest
       with those of other components, until all were compared or are
       connected. A pair is compared if the places in
       the two orders leave room for the similarity; the union's sketch then
       suggests it, and the full sets confirm it.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept
    (doc_id = component_id), row (a digest of doc_id and text) and stays: true
    for the rows of just one doc_id and text of each component, also where
    doc_ids are shared or null. Null or wordless texts have no shingles and
    stand alone. Rows that share a doc_id and a set are kept or not together.
    Empty table: empty. Other columns are ignored.
    """
    if percent < 75:
        raise ValueError("the sketch's bounds hold for similarities of 75 % and more")
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    sketched = stash(map_in_arrow(docs.withColumn("row", F.xxhash64("doc_id", "text")), _sketches(words), "doc_id long, row long, n_shingles long, d1 long, d2 long, sketch array<long>"), "near-sketches")
    classes = sketched.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("one"), F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = stash(classes.withColumn("rep", F.col("one.doc_id")).withColumn("cls", F.monotonically_increasing_id()), "near-classes")
    rows = stash(sketched.select("doc_id", "row", "n_shingles", "d1", "d2"), "near-rows")
    discard(sketched)

    least = lambda n: F.ceil(n * percent / 100)
    k = F.size("sketch")
    need = F.when(F.col("n") > math.floor(SKETCH * percent / 100), F.least(least(k), F.lit(OVERLAP))).otherwise(least(k))
    met = _rare_first(classes.select("cls", F.explode("sketch").alias("v")), classes.select("cls", "n", k.alias("k"), need.alias("need")))
    inside = stash(classes.join(met.select("cls").distinct(), "cls", "left_semi").select("cls", "rep", "n", "d1", "d2"), "near-inside")
    discard(met)

    passed = map_in_arrow(docs.withColumn("at", _place()), _full_sets(words, _bits(inside.select(F.col("rep").alias("doc_id")))), "d1 long, d2 long, shingles array<long>")
    sets = stash(passed.join(inside.select("cls", "d1", "d2"), ["d1", "d2"]).groupBy("cls").agg(F.first("shingles").alias("shingles")), "near-sets")
    lists = _rare_first(sets.select("cls", F.explode("shingles").alias("v")), inside.select("cls", "n", F.col("n").alias("k"), least(F.col("n")).alias("need")))

    nodes = stash(lists.select(F.col("cls").alias("node")).distinct().withColumn("label", F.col("node")), "near-labels")
    turn = 0
    while not lists.isEmpty():
        pairs, lists = _turn(lists, nodes, turn, percent)
        sides = [sets.select(F.col("cls").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab"]
        links = stash(map_in_arrow(pairs.join(sides[0], "a").join(sides[1], "b"), _confirm(percent), "a long, b long"), "near-links")
        nodes = components(nodes, links)
        turn += 1
    discard(sets)

    labels = classes.select("cls", "one", "d1", "d2").join(nodes.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = labels.groupBy("label").agg(F.min("one").alias("one"))
    component = stash(labels.drop("one").join(smallest, "label").select("d1", "d2", F.col("one.doc_id").alias("component_id"), F.col("one.row").alias("stays_row")), "near-components")
    found = rows.join(component, ["d1", "d2"], "left")
    stays = (F.col("n_shingles") == 0) | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row") == F.col("stays_row")))
    found = found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "row", stays.alias("stays"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row", "stays")


def without_near_duplicates(documents: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all its columns; rows without words stay.

    Of rows that share doc_id and text, one stays. What is shuffled is the
    rows that go and the rows that occur more than once; the others pass.
    """
    found = stash(near_duplicates(documents, words=words, percent=percent).select("doc_id", "row", "n_shingles", "stays"), "near-found")
    gone = found.where("not stays").select(F.col("row").alias("_row")).distinct()
    twice = found.where("stays and n_shingles > 0").groupBy(F.col("row").alias("_row")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("_row")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    left = documents.join(stash(gone, "near-gone"), key == F.col("_row"), "left_anti")
    twice = stash(twice, "near-twice")
    return left.join(twice, key == F.col("_row"), "left_anti").unionByName(left.join(twice, key == F.col("_row"), "left_semi").dropDuplicates(["doc_id", "text"]))


def _turn(lists: DataFrame, nodes: DataFrame, turn: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) that this turn compares, and what is left of the lists.

    Turn 0: one class of a list with all others, the one with the smallest
    share of values of its own, as copies lie closest to what they were
    copied from. Later: only lists of several components; as hubs a few such
    classes of the largest one, and members of the others, the smallest first.
    """
    if turn:
        members = lists.join(nodes.select(F.col("node").alias("cls"), "label"), "cls")
        sizes = stash(members.groupBy("v", "label").agg(F.count("*").alias("share")), "near-shares")
        largest = sizes.groupBy("v").agg(F.max(F.struct("share", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("v", F.col("top.label").alias("most"))
        members = stash(members.join(largest, "v"), "near-members")
        inner = F.col("label") == F.col("most")
        order = Window.partitionBy("v", "inner").orderBy("share", "far", "cls")
        ranked = members.join(sizes, ["v", "label"]).withColumn("inner", inner).withColumn("nth", F.row_number().over(order))
        hubs = ranked.where(F.col("nth") <= F.when(F.col("inner"), CENTRES).otherwise(HUBS[min(turn, len(HUBS) - 1)]))
    else:
        members = lists.withColumn("label", F.col("cls"))
        hubs = members.groupBy("v").agg(F.min(F.struct("far", "cls", "n", "at", "label")).alias("h")).select("v", "h.*")
    hubs = stash(hubs.select("v", F.col("cls").alias("hub"), F.col("n").alias("hub_n"), F.col("at").alias("hub_at"), F.col("label").alias("hub_label")), "near-hubs")
    room = F.least(F.col("n") - F.col("at"), F.col("hub_n") - F.col("hub_at"))
    fits = (F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent) & (room * (100 + percent) >= (F.col("n") + F.col("hub_n")) * percent)
    pairs = members.join(hubs, "v").where((F.col("label") != F.col("hub_label")) & fits)
    pairs = stash(pairs.select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct(), "near-pairs")
    left = members.join(hubs.select("v", F.col("hub").alias("cls")), ["v", "cls"], "left_anti").select("v", "cls", "n", "at", "far")
    if not turn:
        left = left.join(left.groupBy("v").agg(F.count("*").alias("m")).where("m > 1").select("v"), "v")
    return pairs, stash(left, "near-lists")
