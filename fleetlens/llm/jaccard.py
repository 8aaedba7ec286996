"""Join of near-equal texts by the Jaccard similarity of their word n-gram sets.

Texts with equal sets form one node.  Tokens (hashed n-grams) are counted over all
nodes; those of more than ``FREQUENT`` nodes are frequent.  In the order (rare first,
then by hash) a node takes a prefix and indexes it: rare tokens alone, frequent tokens
as pairs inside ``CLASSES`` classes.  A class gives no pair for its first token, so the
prefix is extended until

    rare tokens + sum over classes of (tokens in the class - 1)  >  tokens that may differ,

which leaves every link at least one common signature: of two linked nodes take the
one whose prefix ends first; all tokens it shares in its prefix lie in the other's prefix
too, and too few of them can be missing to avoid a common rare token or a pair.  Nodes too
small to get there index their whole set, and their single frequent tokens for each
other.

Entries carry their level, the prefix units before them.  Two sizes fix how many tokens a
linked pair may lack on either side, mostly half of what one size alone allows; a
signature of a higher level makes no candidate.

Only the lowest tokens by hash are counted at first; a node that finds too few rare
ones among them is worked out from its whole set, and its tokens from further up are
looked up among the others.  The counted tokens are moved once, as (node, place, token)
with the row number as node, and those of one node only end there.

Candidates are verified exactly, after a bound from the counted tokens has ruled out most
of the false ones.  First every index entry is compared with one hub per signature, the
node with the fewest tokens of its own, so a group of copies costs one comparison a
member.  Where different components still meet, entries whose own tokens rule every
partner out go without a comparison (``narrowed``), and the rest is searched by
prefixes of the differences from a common reference (``beyond_hubs``); no step pairs
the members of a signature.

Defined cases: null, empty and blank texts have no set and no links (their own
component); fewer words than n make one token; a null doc_id takes part and is
no one's component id while another id is in the component; repeated rows share a node;
an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.joins import cut_side, small_side
from fleetlens.llm.components import components
from fleetlens.llm.registry import query, table
from fleetlens.llm.textbytes import WordHasher, column_bytes, mixed, shingle_hashes
from fleetlens.session import cut, cut_measured

# executors need not have this package: the task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FREQUENT = 24
CLASSES = 8
SIDE_BYTES = 8 * 1024 * 1024  # many broadcast sides live at once here, and all pass the driver
TASKS, TASK_ROWS = 12, 4096  # a table is written by no more tasks than its documents fill, or by the first number
SAMPLE, CROWDED = 4096, 40  # nodes looked at, and those with one token among them that make it crowded


def _small(df: DataFrame) -> DataFrame:
    return small_side(df, limit=SIDE_BYTES)


def _small_cut(df: DataFrame) -> DataFrame:
    return cut_side(df, limit=SIDE_BYTES)


def allowed(n, percent: int):
    """How many of n tokens a linked set may lack; also the extra entries of its prefix."""
    return n - (n * percent + 99) // 100


def counted(n, percent: int):
    """How many tokens of a set, lowest by hash, are counted at first."""
    return np.minimum(n, (allowed(n, percent) + 1) * 3 // 2 + 8)


def token_sets(h: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted token set of each row, from word hashes."""
    tokens = shingle_hashes(h, k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(tokens[a : b - k + 1])
        elif b > a:  # the whole sequence is one token
            yield mixed(shingle_hashes(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield tokens[:0]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32), pa.array(flat))


def _set_rows(k: int, percent: int, whole: bool):
    """Task function: the set of each text, whole or its lowest tokens, and its fingerprint."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for big in batches:
            for a in range(0, big.num_rows, 1000):
                batch = big.slice(a, 1000)
                h, _, _, bounds = hasher.words(*column_bytes(batch.column("text")))
                sizes, prints, parts = [], [], []
                for tokens in token_sets(h, bounds, k):
                    sizes.append(len(tokens))
                    prints.append(int(mixed(tokens).sum(dtype=np.uint64) ^ np.uint64(len(tokens))) if len(tokens) else 0)
                    parts.append(tokens if whole else tokens[: counted(len(tokens), percent)])
                node = np.array(prints, np.uint64).view(np.int64)
                kept = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in kept], pa.array(np.array(sizes, np.int64)), pa.array(node), _lists(parts)],
                    names=[*kept, "n", "node", "tokens"],
                )

    return rows


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, place of its last token, level) of one whole set, sorted by hash.

    Signatures of rare tokens are the tokens themselves.  The level counts the units of
    the prefix (rare tokens, and tokens of a class after its first) before the last token.
    """
    need = allowed(len(tokens), percent) + 1
    rare, often = np.flatnonzero(~frequent), np.flatnonzero(frequent)
    out, at, level = [tokens[rare[:need]]], [rare[:need]], [np.arange(min(len(rare), need))]
    short = need - min(len(rare), need)
    if short:
        kind = (tokens[often] >> np.uint64(32)) % np.uint64(CLASSES)
        first = np.zeros(len(often), bool)
        first[np.unique(kind, return_index=True)[1]] = True
        gained = np.cumsum(~first)
        reached = len(gained) and gained[-1] >= short
        last = int(np.searchsorted(gained, short)) + 1 if reached else len(often)
        for c in range(CLASSES):
            mine = often[:last][kind[:last] == c]
            units = gained[:last][kind[:last] == c]
            i, j = np.triu_indices(len(mine), 1)
            out.append(mixed(tokens[mine[i]] * np.uint64(3) + mixed(tokens[mine[j]])))
            at.append(mine[j])
            level.append(len(rare) + units[j] - 1)
        if not reached:  # only sets of a few tokens: they meet each other on single ones
            out.append(mixed(tokens[often] ^ np.uint64(0x5555555555555555)))
            at.append(often)
            level.append(np.zeros(len(often), np.int64))
    return np.concatenate(out), np.concatenate(at), np.concatenate(level)


def _signature_rows(percent: int):
    """Task function for whole sets with the list of their frequent tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = np.array(batch.column("tokens")[i].as_py(), np.int64).view(np.uint64)
                frequent = np.isin(tokens, np.array(batch.column("often")[i].as_py() or [], np.int64).view(np.uint64))
                sig, at, level = signatures(tokens, frequent, percent)
                m = len(sig)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sig.view(np.int64)), pa.array(np.full(m, batch.column("node")[i].as_py(), np.int64)),
                        pa.array(np.full(m, len(tokens), np.int64)),
                        # rare tokens from beyond the counted ones must be looked up
                        pa.array((at >= counted(len(tokens), percent)) & ~frequent[at]), pa.array(level.astype(np.int64)),
                    ],
                    names=["sig", "node", "n", "beyond", "level"],
                )

    return rows


def may_link(a: np.ndarray, na: int, b: np.ndarray, nb: int, percent: int) -> bool:
    """False if the lowest tokens of two sets already differ in too many places.

    Up to the smaller of the two last hashes both lists are complete, so tokens that only
    one of them has there are missing from the other set: with d of them the
    intersection is at most (na + nb - d) / 2.
    """
    ends = [x[-1] for x, n in ((a, na), (b, nb)) if len(x) < n]
    if ends:
        a, b = a[a <= min(ends)], b[b <= min(ends)]
    common = len(np.intersect1d(a, b, assume_unique=True))
    most = (na + nb - (len(a) + len(b) - 2 * common)) // 2
    return 100 * most >= percent * (na + nb - most)


def _plausible(percent: int):
    """Task function: the pairs whose counted tokens do not rule a link out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for c in ("ta", "tb"):
                column = batch.column(c)
                flat, at = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy()
                lists.append((flat, at - at[0]))
            (fa, oa), (fb, ob) = lists
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            good = [
                may_link(fa[oa[i] : oa[i + 1]], na[i], fb[ob[i] : ob[i + 1]], nb[i], percent) for i in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows


def _compare(percent: int, apart_too: bool = False):
    """Task function: whole sets of pairs in; whether they link, and the tokens only one has, out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for c in ("ta", "tb"):
                column = batch.column(c)
                flat, at = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy()
                lists.append((flat, at - at[0]))
            (fa, oa), (fb, ob) = lists
            linked, diffs = [], []
            for i in range(batch.num_rows):
                a, b = fa[oa[i] : oa[i + 1]], fb[ob[i] : ob[i + 1]]
                apart = np.setxor1d(a, b, assume_unique=True)
                common = (len(a) + len(b) - len(apart)) // 2
                linked.append(100 * common >= percent * (common + len(apart)))
                diffs.append(apart)
            out = [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                [*out, _lists(diffs)] if apart_too else out, names=["a", "b", "linked", *["apart"][: int(apart_too)]]
            )

    return rows


def _held(n: Column, percent: int) -> Column:
    """``counted`` as a column."""
    need = n - F.floor((n * percent + 99) / 100) + 1
    return F.least(n, F.floor(need * 3 / 2) + 8)


def _in_common(na: Column, nb: Column, percent: int) -> Column:
    """How many tokens linked sets of these sizes have in common at least."""
    return F.ceil((na + nb) * percent / (100 + percent) - 1e-9)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _candidates(na: Column, la: Column, nb: Column, lb: Column, percent: int) -> Column:
    """Whether a common signature of levels ``la`` and ``lb`` makes two sets a candidate pair.

    A linked pair has at least percent / (100 + percent) of both sizes in common; a set
    lacks no more than the rest of it, and so many units and one of its prefix do.
    """
    common = _in_common(na, nb, percent)
    return (la <= na - common) & (lb <= nb - common)


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.k, self.percent = k, percent
        self.docs = docs.select("doc_id", "text")
        sets = self.docs.mapInArrow(_set_rows(k, percent, False), "doc_id bigint, n bigint, node bigint, tokens array<bigint>")
        # the narrow table is read several times; its row numbers are fixed once it is written
        rows = cut(sets.withColumnRenamed("node", "print").withColumn("row", F.monotonically_increasing_id()))
        self.members, size = cut_measured(rows.select("doc_id", "n", "print"), F.count("*"))
        # a shuffle may have many more partitions than the rows need; each of them would be a file here and three there
        self.tasks = max(TASKS, -(-size // TASK_ROWS))
        nodes = rows.where("n > 0").groupBy("print").agg(
            F.min("doc_id").alias("label"), F.first("n").alias("n"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("head"),
        )
        # one row per node stands for it, and its number, which packs well, names the node
        self.nodes, self.size = cut_measured(
            nodes.select(F.col("head.row").alias("node"), "print", "label", "n").coalesce(self.tasks), F.count("*")
        )
        # written once: else every reader would move all lists again, or send this side through the driver
        heads = rows.join(_small(self.nodes.select(F.col("node").alias("row"))), "row", "left_semi")
        self.heads = cut(heads.select(F.col("row").alias("node"), "n", "tokens").coalesce(self.tasks))
        repeated = self.members.groupBy("doc_id").count().where("count > 1").select("doc_id")
        self.repeated, self.ids_repeat = cut_measured(repeated.coalesce(self.tasks), F.count("*"))

    def _cut(self, df: DataFrame) -> DataFrame:
        return cut(df.coalesce(self.tasks))

    def _small_cut(self, df: DataFrame) -> DataFrame:
        return _small_cut(df.coalesce(self.tasks))

    def whole_sets(self, nodes: DataFrame) -> DataFrame:
        """(node, n, tokens) with the whole sets of the given nodes, each text worked on once."""
        wanted = self.nodes.select("node", "print", F.col("label").alias("_id"))
        of = self._small_cut(nodes.select("node").distinct().coalesce(self.tasks).join(wanted, "node"))
        # ids that are not broadcast move all texts; nodes have an id in common only where ids repeat
        ids = small_side(of.select("_id").distinct() if self.ids_repeat else of.select("_id"))

        def sets(docs: DataFrame) -> DataFrame:
            texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
            found = texts.mapInArrow(
                _set_rows(self.k, self.percent, True), "doc_id bigint, n bigint, print bigint, tokens array<bigint>"
            )
            mine = (found["print"] == of["print"]) & found["doc_id"].eqNullSafe(of["_id"])
            return found.join(of, mine).select("node", "n", "tokens")

        if not self.ids_repeat:
            return sets(self.docs)
        again = _small(self.repeated)
        same = self.docs["doc_id"].eqNullSafe(again["doc_id"])
        # equal texts under one id come once each
        once, more = (self.docs.join(again, same, how) for how in ("left_anti", "left_semi"))
        return sets(once).union(sets(more).dropDuplicates(["node"]))

    def shared_tokens(self, tokens: DataFrame) -> DataFrame:
        """(node, pos, token, often) of the counted tokens that at least two nodes have.

        Tokens are dealt out once and counted where they then lie.  Those that a sample of
        nodes shows to be crowded would fill a task; they are counted by partial sums and
        their rows are not dealt at all.  The sample picks the way only, all counts are exact.
        """
        every = max(1, self.size // SAMPLE)
        seen = tokens.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).groupBy("token").count()
        crowded = self._small_cut(seen.where(F.col("count") >= CROWDED).select("token"))
        counts = tokens.join(crowded, "token", "left_semi").groupBy("token").agg((F.count("*") > FREQUENT).alias("often"))
        crowds = tokens.join(self._small_cut(counts), "token")
        rest = tokens.join(crowded, "token", "left_anti")
        rest = rest.withColumn("cnt", F.count("*").over(Window.partitionBy("token"))).where("cnt > 1")
        rest = rest.withColumn("often", F.col("cnt") > FREQUENT)
        columns = ["node", "pos", "token", "often"]
        return self._cut(rest.select(columns).union(crowds.select(columns)))

    def index(self) -> DataFrame:
        """(sig, node, n, level, solo): every signature that at least two nodes may share.

        ``solo`` counts the node's counted tokens that no other node has counted.
        """
        tokens = self.heads.select("node", F.posexplode("tokens").alias("pos", "token"))
        shared = self.shared_tokens(tokens)
        self.shared = shared.select("node", "token")
        often = self._small_cut(shared.where("often").select("token").distinct())
        held, need = _held(F.col("n"), self.percent), F.col("n") - F.floor((F.col("n") * self.percent + 99) / 100) + 1
        per_node = shared.groupBy("node").agg(F.count("*").alias("_shared"), F.count_if("often").alias("_often"))
        sizes = self._small_cut(self.nodes.select("node", "n").join(per_node.coalesce(self.tasks), "node", "left").select(
            "node", "n", F.coalesce("_often", F.lit(0)).alias("_often"),
            (held - F.coalesce("_shared", F.lit(0))).cast("bigint").alias("solo"),
        ))
        hard = self._small_cut(sizes.where((F.col("_often") > 0) & (held - F.col("_often") < need)).select("node"))
        sets = self._cut(self.whole_sets(hard))
        found = sets.select("node", F.explode("tokens").alias("token")).join(often, "token").groupBy("node").agg(
            F.collect_list("token").alias("often")  # at most the tokens of one text
        )
        hard_sigs = self._cut(sets.join(found.coalesce(self.tasks), "node", "left").mapInArrow(
            _signature_rows(self.percent), "sig bigint, node bigint, n bigint, beyond boolean, level bigint"
        ))
        # tokens that hard nodes index from beyond the counted part, in the others' counted parts
        beyond = self._cut(hard_sigs.where("beyond").select(F.col("sig").alias("token")).distinct())
        known = shared.join(small_side(beyond), "token", "left_semi").select("token").distinct()
        far = self._cut(beyond.join(known, "token", "left_anti"))
        looked_up = tokens.join(small_side(far), "token").withColumn("often", F.lit(False))  # else all tokens move again
        easy = shared.unionByName(looked_up).join(hard, "node", "left_anti")
        # place among the rare tokens = place minus the frequent ones before it
        before = easy.where("often").groupBy("node").agg(F.collect_list("pos").alias("_often_at"))
        rank = F.col("pos") - F.coalesce(F.size(F.filter("_often_at", lambda p: p < F.col("pos"))), F.lit(0))
        easy = easy.where(~F.col("often")).join(before, "node", "left").withColumn(
            "level", F.when(F.col("_often_at").isNull(), F.col("pos")).otherwise(rank).cast("bigint")
        )
        sizes = sizes.drop("_often")
        easy = easy.select(F.col("token").alias("sig"), "node", "level").join(sizes, "node").where(F.col("level") < need)
        hard_sigs = hard_sigs.select("sig", "node", "level").join(sizes, "node")
        return easy.union(hard_sigs).select("sig", "node", "n", "level", "solo")

    def _beside(self, pairs: DataFrame, lists: DataFrame) -> DataFrame:
        """Pairs with the sizes and token lists of both sides."""
        left = lists.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
        right = lists.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
        return pairs.join(left, "a").join(right, "b")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Exact comparison of the pairs that may link: (a, b, linked).

        The counted tokens rule most pairs out; whole sets are moved for the rest.
        """
        # ends that are not broadcast move all lists
        ends = cut_side(_ends(pairs).coalesce(self.tasks))
        counted_lists = self.heads.select("node", "n", "tokens").join(ends, "node", "left_semi")
        pairs = self._cut(
            self._beside(pairs, counted_lists).select("a", "b", "na", "nb", "ta", "tb")
            .mapInArrow(_plausible(self.percent), "a bigint, b bigint").distinct()
        )
        both = self._beside(pairs, self._cut(self.whole_sets(_ends(pairs))))
        compared = both.select("a", "b", "ta", "tb").mapInArrow(_compare(self.percent), "a bigint, b bigint, linked boolean")
        return self._cut(compared.dropDuplicates(["a", "b"]))

    def _still_open(self, entries: DataFrame) -> DataFrame:
        """The entries of signatures in which several components meet."""
        met = entries.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        return self._cut(entries.join(met.select("sig").coalesce(self.tasks), "sig", "left_semi"))

    def narrowed(self, entries: DataFrame) -> DataFrame:
        """Open entries (sig, node, n, comp, ...) without the nodes that can link with no other component there.

        A token that no other open component holds is missing from every possible
        partner.  Where a node has more of these than it may lack beside the smallest
        node of the signature, the entry goes; with it others' tokens become their own,
        so this repeats while it still helps.  Nothing is paired: a cluster of copies
        that all lie beyond the limit, each with changes of its own, vanishes here.
        """
        # first by the counted tokens, of which those of one node only are known; then by whole sets
        entries = self._without_own(entries, self.shared, _held(F.col("n"), self.percent))
        del self.shared  # its files may go
        lists = self._cut(self.whole_sets(entries.select("node").distinct()).select("node", "tokens"))
        tokens, left = lists.select("node", F.explode("tokens").alias("token")), entries.count()
        while left:
            entries = self._without_own(entries, tokens, F.col("n"))
            now = entries.count()
            if 2 * now > left:
                break
            left = now
        return entries

    def _without_own(self, entries: DataFrame, tokens: DataFrame, known: Column) -> DataFrame:
        """One round of ``narrowed`` over ``tokens`` (node, token), which stand for ``known`` of a node."""
        comps = self._small_cut(entries.select("node", "comp").distinct())
        tokens = tokens.join(comps, "node").coalesce(self.tasks)
        spread = tokens.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        shared = self._small_cut(spread.where("lo < hi").select("token"))
        common = tokens.join(shared, "token", "left_semi").groupBy("node").agg(F.count("*").alias("_common"))
        common = common.coalesce(self.tasks)
        least = entries.groupBy("sig").agg(F.min("n").alias("_least")).coalesce(self.tasks)
        other = F.greatest(F.col("_least"), F.ceil(F.col("n") * self.percent / 100 - 1e-9))
        own = known - F.coalesce("_common", F.lit(0))
        return self._still_open(
            entries.join(common, "node", "left").join(least, "sig")
            .where(own <= F.col("n") - _in_common(F.col("n"), other, self.percent)).drop("_common", "_least")
            .coalesce(self.tasks)
        )

    def links(self) -> DataFrame:
        """Links enough to connect all that is connected: not each one inside a component."""
        index = self._cut(self.index())
        # the hub of a signature is the node with the fewest tokens of its own
        hubs = index.groupBy("sig").agg(F.min(F.struct("solo", "node", "n", "level")).alias("hub"), F.count("*").alias("m"))
        entries = self._cut(index.join(hubs.where("m > 1").coalesce(self.tasks), "sig").select("sig", "node", "n", "level", "hub"))
        del index, hubs  # their files may go
        near = _candidates(F.col("n"), F.col("level"), F.col("hub.n"), F.col("hub.level"), self.percent)
        pairs = self._cut(
            entries.where((F.col("node") != F.col("hub.node")) & near)
            .select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
        )
        links = self.verify(pairs).where("linked").select("a", "b")
        placed = entries.select("sig", "node", "n").join(_small(components(links, tasks=self.tasks)), "node", "left").withColumn(
            "comp", F.coalesce("comp", "node")
        )
        return links.union(self.beyond_hubs(self.narrowed(self._still_open(placed.coalesce(self.tasks))), pairs, links))

    def beyond_hubs(self, entries: DataFrame, pairs: DataFrame, links: DataFrame) -> DataFrame:
        """Links between components that still meet in a signature: (a, b).

        Every signature takes one reference, and D is a node's difference from it.  A node
        names the hub it is linked with, of several the one with most links, or else of those
        it was compared with; the reference is the one most nodes of the signature name.  (A
        hub that most know and few link with lies outside: what tells it from a cluster
        would be in the D of all members, and they would meet in pairs.)  Two nodes differ by
        |Da| + |Db| - 2 |Da and Db|, so a link needs (|Da| + |Db| - most) / 2 common
        tokens in the differences.  What is not linked with the reference has a large
        difference and needs a large overlap: it is searched by prefixes of D, rarest token
        within the reference first, and against nodes that are linked with the reference
        (one component, so not among each other) by prefixes of theirs.  Common passages
        and the base of a cluster of copies are no part of D and form no pairs.
        """
        comp_of = entries.select("node", "n", "comp").distinct()
        known = entries.select("node").distinct()
        mine = pairs.join(links.withColumn("mine", F.lit(1)), ["a", "b"], "left")
        mine = mine.select(F.col("a").alias("node"), F.col("b").alias("ref"), F.coalesce("mine", F.lit(0)).alias("mine"))
        known = self._cut(
            mine.join(known, "node").unionByName(known.select("node", F.col("node").alias("ref"), F.lit(0).alias("mine")))
        )
        fame = known.groupBy("ref").agg(F.sum("mine").alias("near"), F.count("*").alias("fame"))
        best = known.join(fame.coalesce(self.tasks), "ref").coalesce(self.tasks).groupBy("node").agg(
            F.max(F.struct("mine", "near", "fame", "ref")).alias("ref")
        )
        named = entries.join(best.coalesce(self.tasks), "node").coalesce(self.tasks)
        votes = named.groupBy("sig", F.struct("ref.near", "ref.fame", "ref.ref").alias("ref")).agg(F.count("*").alias("votes"))
        refs = votes.groupBy("sig").agg(F.max(F.struct("votes", "ref.near", "ref.fame", "ref.ref")).alias("ref")).coalesce(self.tasks)
        uses = entries.join(refs, "sig").coalesce(self.tasks)
        uses = self._cut(uses.select(F.col("node").alias("a"), F.col("ref.ref").alias("b")).distinct())
        both = self._beside(uses, self._cut(self.whole_sets(_ends(uses))))
        compared = self._cut(both.select("a", "b", "ta", "tb").mapInArrow(
            _compare(self.percent, True), "a bigint, b bigint, linked boolean, apart array<bigint>"
        ).join(comp_of.withColumnRenamed("node", "a"), "a").withColumn("d", F.size("apart")))
        found = compared.where("linked and a <> b").select("a", "b")
        most = lambda n, other: n + other - 2 * _in_common(n, other, self.percent)
        bounds = compared.groupBy("b").agg(
            F.max("n").alias("_widest"), F.min(F.when(~F.col("linked"), F.col("d"))).alias("_far")
        ).where("_far is not null")
        tokens = compared.select("a", "b", "n", "comp", "linked", "d", F.explode("apart").alias("token"))
        held = tokens.groupBy("b", "token").agg(F.count("*").alias("held")).where("held > 1")
        ordered = tokens.join(held, ["b", "token"]).groupBy("a", "b", "n", "comp", "linked", "d").agg(
            F.array_sort(F.collect_list(F.struct("held", "token"))).alias("shared")  # at most the tokens of two texts
        )
        widest = F.least(F.col("_widest"), F.floor(F.col("n") * 100 / self.percent))
        loosest = (F.col("n") + widest) * (100 - self.percent) / (100 + self.percent)  # never below ``most``
        placed = ordered.join(bounds, "b").select(
            "a", "b", "n", "comp", "linked", "d", F.posexplode("shared").alias("pos", "x"),
            # tokens of no other node stand before the shared ones
            (F.col("d") - F.size("shared")).alias("_alone"),
            F.floor((F.col("d") - F.col("_far") + loosest) / 2 + 1e-9).alias("_last"),
        ).withColumn("pos", F.col("pos") + F.col("_alone")).withColumn("token", F.col("x.token"))
        placed = self._cut(placed.select("a", "b", "token", "n", "comp", "linked", "d", "pos", "_last"))
        far = placed.where(~F.col("linked"))
        near = placed.where(F.col("pos") <= F.col("_last"))
        left, right = far.alias("l"), near.alias("r")
        l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
        common = F.ceil((l("d") + r("d") - most(l("n"), r("n"))) / 2)
        met = left.join(right, (l("b") == r("b")) & (l("token") == r("token"))).where(
            (l("comp") != r("comp")) & (r("linked") | ((l("a") < r("a")) & (l("pos") <= l("_last"))))
            & (l("pos") <= l("d") - common) & (r("pos") <= r("d") - common)
        )
        met = met.select(F.least(l("a"), r("a")).alias("a"), F.greatest(l("a"), r("a")).alias("b")).distinct()
        return found.union(self.verify(self._cut(met)).where("linked").select("a", "b"))


def near_equal(docs: DataFrame, *, k: int = 4, percent: int = 85) -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union.

    Reads ``doc_id`` and ``text``.  Returns doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links) and node (equal for equal sets; null without words).
    """
    join = _Join(docs, k, percent)
    comps = components(join.links(), tasks=join.tasks).coalesce(join.tasks)
    nodes = join.nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).coalesce(join.tasks)
    lowest = nodes.groupBy("comp").agg(F.min("label").alias("component_id")).coalesce(join.tasks)
    named = nodes.join(lowest, "comp").select("node", "print", "component_id").coalesce(join.tasks)
    rows = join.members.join(named, "print", "left")
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("node")).alias("node"),
    )


def one_of_each(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each component kept, the one of the smallest doc_id.

    Documents without words stay.  Rows of a repeated doc_id stay or go together, and of
    equal rows among them one stays.  Columns as given.
    """
    found = cut(near_equal(docs, k=k, percent=percent).select("doc_id", "node", "component_id"))
    keep = found.where(F.col("node").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = keep.select(F.col("doc_id").alias("_id")).distinct()
    # fewer go than stay, and a side that is not broadcast moves all texts
    go = found.join(keep, found["doc_id"].eqNullSafe(keep["_id"]), "left_anti").select(F.col("doc_id").alias("_id"))
    go = cut_side(go.distinct())
    kept = docs.join(go, docs["doc_id"].eqNullSafe(go["_id"]), "left_anti")
    twice = found.groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id")
    repeated, some = cut_measured(twice, F.count("*"))
    if not some:
        return kept
    repeated = _small(repeated)
    again = kept["doc_id"].eqNullSafe(repeated["_id"])
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates())


@query("op6_jaccard_join")
def op6_jaccard_join(spark, sf_dir):
    return near_equal(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
