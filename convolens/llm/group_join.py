"""N-gram Jaccard join by grouped prefixes: groups of documents with one prefix and size, then their members.

A document's shingles are put in one order for all, by how many sets they stand in, rare ones first. Two sets of the
least similarity share one of their first shingles, the prefix. Equal sets are one class, classes of the same prefix and
size one group. Groups that share a prefix shingle and have sizes near enough are candidates; their members are verified
by their sets.

Only three of eight shingles, by their hash, are looked at for this: two sets of the least similarity miss at most a known
number of each other's shingles, so of a set that has more than that many of the looked-at kind, at least the rest is
shared. Sets with fewer post all of their shingles. Shingles of one set alone are counted, not kept: they come first in
the order, and no list needs them. A set with too few others links with none and is done.

Links are wanted as components, so no list of groups is turned into all of its pairs: in each round a list has one
hub, and members that are not yet in its component are verified against it; lists whose members are all in one
component are done. As soon as the pairs that are left are no more than a few for each place of the lists, or the
rounds are over, what is left is verified pair by pair, in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.llm import common as C
from convolens.llm.components import components

#: Shingles with more than one in this many of all places: there are fewer of them than this, so they can be broadcast.
HOT = 1000
#: Rounds of hubs before the rest is verified pair by pair.
ROUNDS = 3
#: Hubs of a list in each round after the first.
HUBS = 8
#: Columns of a set's parities.
BITS = ("b0", "b1", "b2", "b3")
#: Pairs left for each place in a list, up to which all of them are looked at.
FEW = 1


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of lower-cased words, as ascending 64-bit hashes; fewer words are one shingle."""
    starts, ends, first = C.word_spans(data, offsets)
    hashes = C.word_hashes(data, starts, ends, lower=True)
    prefix = C.Prefix(hashes, 31)
    at = np.arange(max(0, len(hashes) - words + 1))
    grams = prefix.of(at, at + words)
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            # The length keeps short texts apart from shingles.
            yield C.mix(prefix.of(np.array([a]), np.array([b])) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def sets_of(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    data, offsets = C.text_bytes(column)
    for a, b in C.pieces(offsets, 4 * C.PIECE):
        yield from shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)


def counted(own: np.ndarray) -> bytes:
    """How many of a set's shingles have each value of the hash's last byte; 255 stands for that many or more."""
    return np.minimum(np.bincount(own.view(np.uint8)[:: 8], minlength=256), 255).astype(np.uint8).tobytes()


def most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An upper bound of the shared shingles for each row of counts."""
    a, b = (np.where(x == 255, 1 << 40, x.astype(np.int64)) for x in (a, b))
    return np.minimum(a, b).sum(axis=1)


def parities(own: np.ndarray) -> np.ndarray:
    """For each value of the hash's second byte whether an odd number of a set's shingles have it, as four 64-bit numbers.

    Sets that differ by k shingles differ in at most k of these bits.
    """
    odd = np.bincount(own.view(np.uint8)[1::8], minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def alike(a: str, b: str, a_n: Column, b_n: Column, percent: int) -> Column:
    """Whether sets with these parities can be similar: they miss at most a known number of each other's shingles."""
    apart = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in BITS[1:]), F.bit_count(F.col(a)[BITS[0]].bitwiseXOR(F.col(b)[BITS[0]])))
    return apart * (100 + percent) <= (a_n + b_n) * (100 - percent)


def shingled(texts: DataFrame, words: int, percent: int, whole: bool) -> DataFrame:
    """doc, n, two hashes of the set, and `tokens`: its shingles with `counts` by last byte and parities if `whole`, else those that it posts."""
    names = ["doc", "n", "h1", "h2", "tokens"] + ["counts", *BITS] * whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.forget()
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                own = list(sets_of(part.column(1), words))
                sums = lambda k: pa.array(C.signed(np.array([C.mix(x + np.uint64(k)).sum() for x in own], np.uint64)))
                out = own if whole else [posted(x, percent) for x in own]
                ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(C.signed(np.concatenate(out))))
                columns = [part.column(0), pa.array([len(x) for x in own], pa.int64()), sums(1), sums(2), tokens]
                if whole:
                    bits = np.array([parities(x) for x in own], np.int64).reshape(-1, len(BITS))
                    columns += [pa.array([counted(x) for x in own], pa.binary()), *map(pa.array, np.ascontiguousarray(bits.T))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc long, n long, h1 long, h2 long, tokens array<bigint>" + (", counts binary, " + ", ".join(f"{b} long" for b in BITS)) * whole
    return texts.select("doc", "text").mapInArrow(run, schema)


def posted(own: np.ndarray, percent: int) -> np.ndarray:
    """Three of eight shingles of a set, by their hash; all if those are no more than a similar set may miss."""
    some = own[own & np.uint64(7) < 3]
    return some if len(some) > len(own) * (100 - percent) // 100 else own


def shared_shingles(sets: DataFrame) -> DataFrame:
    """token, df: posted shingles of two documents or more, and of how many."""
    return sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")


def prefixes(sets: DataFrame, shared: DataFrame, percent: int, key: list[str]) -> DataFrame:
    """`key` (what tells sets apart), n, prefix, some, before and tokens: of each set that others may reach, how many
    shingles come before its first shared one, and those of its prefix that are shared.

    The most common shingles are few and go to the sets; the others, whose number grows with the documents, are met by key.
    """
    places = sets.select(*key, F.explode("tokens").alias("token"))
    total = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    hot = F.broadcast(shared.filter(F.col("df") * HOT > total))
    cold = places.join(hot.select("token"), "token", "left_anti").join(shared.filter(F.col("df") * HOT <= total).hint("merge"), "token")
    own = places.join(hot, "token").unionByName(cold).groupBy(*key).agg(F.collect_list(F.struct("df", "token")).alias("own"))
    own = own.join(sets.select(*key, "n", F.size("tokens").alias("posted")).hint("merge"), key)
    # A similar set misses at most so many of the shingles, so one of the first slack + 1 that are posted is shared.
    slack = F.expr(f"n * {100 - percent} div 100")
    some = F.col("posted") < F.col("n")
    own = own.filter(F.size("own") >= F.when(some, F.col("posted") - slack).otherwise(1))
    unshared = F.when(some, F.col("posted") - F.size("own")).otherwise(0)
    head = F.when(some, F.slice(F.sort_array("own"), F.lit(1), F.greatest(F.lit(0), slack + 1 - unshared).cast("int"))).otherwise(F.col("own"))
    own = own.select(*key, "n", some.alias("some"), unshared.alias("before"), F.transform(head, lambda x: x["token"]).alias("tokens"))
    prefix = F.struct("some", "before", F.xxhash64("tokens").alias("hash"), F.col("tokens")[0].alias("first"))
    return own.select(*key, "n", "some", prefix.alias("prefix"), "before", "tokens")


def may_reach(a_n: Column, a_pos: Column, b_n: Column, b_pos: Column, percent: int) -> Column:
    """Whether two sets can be similar if the shingle at these places is the first that they share: it and all behind it count at most."""
    return F.least(a_n - a_pos, b_n - b_pos) * (100 + percent) >= (a_n + b_n) * percent


def hopeful(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets can be similar by their counts, which are a fiftieth of long sets. No similar pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(x.as_py() for x in batch.column(k)), np.uint8).reshape(-1, 256) for k in (2, 3))
                shared = most_shared(a, b)
                total = batch.column(4).to_numpy() + batch.column(5).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(shared * (100 + percent) >= total * percent))

    at = lambda end: counts.select(F.col("doc").alias(end), F.col("counts").alias(f"{end}_c"), F.col("n").alias(f"{end}_n"))
    joined = pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "a_c", "b_c", "a_n", "b_n")
    return joined.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets are similar: 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2), batch.column(3)):
                both = np.sort(np.concatenate([x.values.to_numpy(), y.values.to_numpy()]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                hit.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    at = lambda end: sets.select(F.col("doc").alias(end), F.col("tokens").alias(f"{end}_set"))
    return pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(compare, "a long, b long")


def link_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets are similar: id_col, n_shingles, component_id, class_id.

    A shingle is `words` lower-cased words; a text of fewer words is one shingle, one without words, or null, has
    none and links with nothing. component_id is the smallest id that links reach, class_id the smallest with
    the same set. Rows that share an id are one node of the links; rows without an id take no part and have null
    components. Equal rows get equal results, and an empty table none.
    """
    C.positive("words", words)
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    C.small_batches(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    sets = C.staged(shingled(texts, words, percent, False), "sets")
    rows = C.staged(sets.select("doc", "n", "h1", "h2"), "rows")
    nodes = rows.filter("doc IS NOT NULL AND n > 0")
    key = ["n", "h1", "h2"]
    classes = C.staged(nodes.groupBy(*key).agg(F.min("doc").alias("class")), "classes")
    repeating = _repeating(nodes)
    once = sets.filter("doc IS NOT NULL AND n > 0")
    once = once.dropDuplicates(["doc", "h1", "h2"]) if repeating else once
    shared = C.staged(shared_shingles(once), "shared")
    # One row per class from here on.
    heads = classes.select(F.col("class").alias("doc"), "h1", "h2")
    # An id of several sets needs their hash to tell them apart, which others spare.
    if repeating:
        firsts = prefixes(once, shared, percent, ["doc", "h1"]).join(heads.select("doc", "h1"), ["doc", "h1"], "left_semi")
    else:
        firsts = prefixes(once, shared, percent, ["doc"]).join(heads.select("doc"), "doc", "left_semi")
    firsts = C.staged(firsts, "prefixes")
    C.discard(shared, sets)
    # Whole sets of what is left: few, since most documents share too little with any other.
    # Their texts alone are shuffled. A semi-join would be pushed below the filter, so it is a join with distinct ids.
    near = firsts.select("doc").distinct()
    left = C.hits(texts, "doc", firsts).filter("hit").join(near, "doc").select("doc", "text")
    own = shingled(left, words, percent, True).join(heads, ["doc", "h1", "h2"], "left_semi")
    own = C.staged(own.dropDuplicates(["doc", "h1", "h2"]) if repeating else own, "own")
    groups = firsts.groupBy("prefix", "n").agg(F.min("doc").alias("group"))
    members = C.staged(firsts.join(groups, ["prefix", "n"]).select(F.col("doc").alias("class"), "group", "n").distinct(), "members")
    # The prefix of one document for each group; only lists with two groups go on.
    heads = firsts.join(members.filter("class = group").select(F.col("group").alias("doc")).distinct(), "doc", "left_semi")
    places = heads.select(F.col("doc").alias("group"), "n", "some", "before", F.posexplode("tokens").alias("at", "token"))
    # Of a set that posts all, others that do not may share more than what is posted.
    places = C.staged(places.select("group", "n", F.when(F.col("some"), F.col("before") + F.col("at")).otherwise(0).alias("pos"), "token"), "places")
    several = places.groupBy("token").agg(F.min("group").alias("least"), F.max("group").alias("most")).filter("least < most").select("token")
    lists = C.staged(places.join(several, "token"), "lists")
    C.discard(places, firsts)
    roots = C.staged(_classes(lists, members, own, percent), "classes")
    C.discard(lists, own, members)
    named = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = C.staged(_one_id(nodes, named) if repeating else named, "named")
    # Back to all rows: by class, then by component.
    out = rows.join(named, key, "left")
    has = F.col("doc").isNotNull()
    return out.select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(has, F.coalesce("root", "doc")).alias("component_id"), F.when(has, F.coalesce("class", "doc")).alias("class_id"),
    )


def _one_id(nodes: DataFrame, named: DataFrame) -> DataFrame:
    """`named` with the components of one id's different sets as one."""
    ids = nodes.join(named, ["n", "h1", "h2"]).select("doc", "root").distinct()
    least = ids.groupBy("doc").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("doc", "a")
    ends = components(ids.join(least, "doc").select("a", F.col("root").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("next"))
    return named.join(ends, "root", "left").withColumn("root", F.coalesce("next", "root")).drop("next")


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of their component, with all columns; one of rows that share an id.

    Rows without an id stay.
    """
    found = link_components(docs, words, percent, id_col, text_col).select(F.col(id_col).alias("id"), "component_id").filter("id IS NOT NULL")
    # Ids that go, or stay in one of their rows; all others stay as they are, without a shuffle of their texts.
    odd = C.staged(found.groupBy("id").agg(F.count_if(F.col("id") == F.col("component_id")).alias("least")).filter("least <> 1"), "odd")
    rows = C.hits(docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*[F.col(c) for c in docs.columns]).alias("row")), "id", odd)
    kept = rows.filter("id IS NULL OR NOT hit").select("row")
    # An anti-join would be pushed below the filter.
    doubtful = rows.filter("id IS NOT NULL AND hit")
    kept = kept.unionByName(doubtful.join(odd, "id", "left").filter("least IS NULL").select("row"))
    twice = odd.filter("least > 1")
    if twice.take(1):
        again = C.hits(rows.drop("hit"), "id", twice).filter("hit").join(twice, "id")
        kept = kept.unionByName(again.dropDuplicates(["id"]).select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _repeating(rows: DataFrame) -> bool:
    """Whether an id stands in several rows, whose shingles then meet in one list twice."""
    return bool(rows.groupBy("doc").count().filter("count > 1 AND doc IS NOT NULL").take(1))


def _mask(turn: int, i: int) -> Column:
    """What a list's groups are combined with to put them in an order of their own."""
    return F.shiftrightunsigned(F.xxhash64("token", F.lit(turn), F.lit(i)), 1)


def _classes(lists: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """class, root: the smallest class that links reach from each."""
    spark = lists.sparkSession
    tried = spark.createDataFrame([], "a long, b long")
    bits = sets.select(F.col("doc").alias("class"), "n", F.struct(*BITS).alias("bits"))
    known, held, places = members.join(bits, ["class", "n"]).withColumn("root", F.col("class")), [], lists.count()
    for turn in range(ROUNDS + 1):
        known = C.staged(known, "known")
        C.discard(*held)
        held = [known]
        # A group whose members are apart counts as a component of its own.
        apart = F.min("root") != F.max("root")
        spans = known.groupBy("group").agg(F.when(apart, -1 - F.col("group")).otherwise(F.min("root")).alias("root"))
        # Hubs are of the list's largest component: first the group with the fewest rare shingles before the list's own,
        # which is the likeliest original of a cluster, and each other group tries the hub it shares most with. Later
        # they are any HUBS groups, others in each list and round, and groups that are still outside try all of them.
        by_root = lists.join(spans, "group").groupBy("token", "root")
        if turn == 0:
            counted = by_root.agg(F.count("*").alias("n"), F.array(F.min(F.struct("pos", "group"))["group"]).alias("hubs"))
        else:
            lowest = [F.min(F.col("group").bitwiseXOR(_mask(turn, i))).alias(f"m{i}") for i in range(HUBS)]
            hubs = F.array_distinct(F.array(*[F.col(f"m{i}").bitwiseXOR(_mask(turn, i)) for i in range(HUBS)]))
            counted = by_root.agg(F.count("*").alias("n"), *lowest).select("token", "root", "n", hubs.alias("hubs"))
        state = (
            counted.groupBy("token")
            .agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "root", "hubs")).alias("top"), F.min("root").alias("least"))
            .filter("parts > 1 OR least < 0")
            .select("token", "top.hubs", F.col("top.root").alias("most"), ((F.col("all") - F.when(F.col("top.root") < 0, 0).otherwise(F.col("top.n"))) * F.col("all")).alias("pairs"))
        )
        state = C.staged(state, "open")
        held.append(state)
        rest = turn == ROUNDS or (state.agg(F.sum("pairs")).first()[0] or 0) <= FEW * places
        # Sets that are too different are told apart where lists meet: a common line would make rows of all their pairs.
        # Only a group of one set has its parities; members of others are looked at below.
        alone = known.groupBy("group").agg(F.count("*").alias("m"), F.first("bits").alias("bits")).filter("m = 1").drop("m")
        h = lists.join(alone, "group", "left")
        h = h.select(F.col("token").alias("h_token"), F.col("group").alias("hub"), F.col("n").alias("h_n"), F.col("pos").alias("h_pos"), F.col("bits").alias("h_bits"))
        reach = may_reach(F.col("n"), F.col("pos"), F.col("h_n"), F.col("h_pos"), percent) & (F.col("group") != F.col("hub"))
        reach = reach & F.coalesce(alike("bits", "h_bits", F.col("n"), F.col("h_n"), percent), F.lit(True))
        if rest:
            outside = lists.join(state.select("token", "most"), "token").join(spans, "group")
            outside = outside.filter((F.col("root") != F.col("most")) | (F.col("root") < 0)).select("token", "group", "n", "pos")
            outside = outside.join(alone, "group", "left")
            pairs = outside.join(h, (F.col("token") == F.col("h_token")) & reach).select("group", "hub").distinct().withColumn("n_shared", F.lit(1))
        else:
            hubs = h.join(state.select(F.col("token").alias("h_token"), F.explode("hubs").alias("hub")), ["h_token", "hub"])
            pairs = lists.join(alone, "group", "left").join(hubs, (F.col("token") == F.col("h_token")) & reach).groupBy("group", "hub").agg(F.count("*").alias("n_shared"))
        end = lambda e: [F.col("class").alias(e), F.col("root").alias(f"{e}_root"), F.col("bits").alias(f"{e}_bits"), F.col("n").alias(f"{e}_n")]
        near = (F.col("a_root") != F.col("b_root")) & alike("a_bits", "b_bits", F.col("a_n"), F.col("b_n"), percent)
        pairs = pairs.join(known.select("group", *end("a")), "group").join(known.select(F.col("group").alias("hub"), *end("b")), "hub")
        pairs = pairs.filter(near).select("a", "b", "n_shared")
        # Within a group: each member with the group's first, and at last all members that are still apart.
        within = known.select("group", *end("a")).join(known.select("group", *end("b")), "group").filter((F.col("a") > F.col("b")) & near)
        within = (within if rest else within.filter(F.col("b") == F.col("group"))).select("a", "b")
        if turn == 0 and not rest:
            pairs = pairs.groupBy("a").agg(F.max(F.struct("n_shared", "b")).alias("best")).select("a", "best.b")
        pairs = pairs.select("a", "b")
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(within).distinct()
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = pairs if rest else C.staged(pairs, "pairs")
        likely = C.staged(hopeful(pairs, sets, percent), "likely")
        if likely.take(1):
            found = C.staged(verified(likely, sets, percent), "similar")
            held += [likely, found]
            at = lambda end: known.select(F.col("class").alias(end), F.col("root").alias(f"{end}_root"))
            merged = components(found.join(at("a"), "a").join(at("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
            known = known.join(merged.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            known = known.select("class", "group", "n", "bits", F.coalesce("next", "root").alias("root"))
        if rest:
            break
        tried = tried.unionByName(pairs)
    # Sets of one id share their node, which takes the least root.
    return known.groupBy("class").agg(F.min("root").alias("root"))
