"""N-gram Jaccard join by grouped prefixes.

Documents are sets of ``n``-word shingles; two link when their Jaccard similarity is at
least num / den.  Equal sets are collapsed first.  Shingles are ordered by how many sets
hold them (in powers of two, then by hash), rarest first; sets that link share a shingle among
their first size - ceil(size * num / den) + 1.  Shingles of one set only cannot be shared and
leave the prefix, and with them most documents.

Sets with equal prefixes and size form a group.  Under each prefix shingle a few documents are
pivots.  A shingle's pivots are paired with its groups that hold another component, if sizes and places
allow the similarity; pairs of document and group are filtered once more by their whole prefixes, and the
groups that remain are expanded to members, which are verified on their whole sets.  In the first two
rounds the pivot is the first document by a hash, so that lists which share documents share pivots, and
each group is paired with one pivot only, the one it shares most shingles with: a family of near copies
gathers about its leaders at the cost of one pair for each member.  Then each pivot is compared with
all that the filters leave, and is done with under that shingle.  Sets that share a shingle and the one before
it in both prefixes are left to the one before, so that a passage that many documents share, a run of equal
shingles in their prefixes, pairs them once and not under each of its shingles.  Rounds go on, with 4 times the pivots of
the last, until the documents left under every shingle belong to one component; what a shingle is done with is no
target under it either.  Members that share prefixes but do not link meet their pivots in the end, so those rounds also
compare parities: two sets differ in at least as many shingles as the 256 parities of their shingles' hashes do, and of
a group the parities count that its members have in common.  No link between components is missed.

Frequencies come through ``packed``: each chunk sends its distinct shingles once.

Defined cases: null text or text without words is an empty set, linked with nothing;
fewer words than ``n`` make one shingle of them all; a null doc_id is given no component;
rows with equal ids and texts are equal sets; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packed as P
from .common import U64, lower_ascii, map_arrow, mix, ngram_hashes, span_hashes, text_bytes, text_of_item, window_ok, word_spans, write_scratch
from .components import components


PARITIES = 256


def parities(g: np.ndarray) -> list[int]:
    """Of the hashes that end in each number below ``PARITIES``, whether there is an odd number: bits of four 64-bit integers.

    A hash that one of two sets holds alone changes one bit, so sets differ in no fewer hashes than bits."""
    odd = np.bincount((g % U64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


class Chunk:
    """Distinct shingles of a chunk's documents: hashes and the document of each, document by document."""

    def __init__(self, body: bytes, n: int):
        self.table = P.read_body(body)
        data, off = text_bytes(self.table.column(1))
        s, e, woff = word_spans(data, off)
        h = span_hashes(lower_ascii(data), s, e)
        at = np.flatnonzero(window_ok(woff, n))
        g, d = ngram_hashes(h, n)[at], text_of_item(woff)[at]
        words = np.diff(woff)
        short = np.flatnonzero((words > 0) & (words < n))  # one shingle of all words, unlike any of n
        few = [_sequence(h[woff[i]:woff[i + 1]]) for i in short]
        g = np.concatenate([g, np.array(few, U64)])
        d = np.concatenate([d, short])
        order = np.lexsort((g, d))
        g, d = g[order], d[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        self.g, self.d = g[new], d[new]
        self.rows = len(off) - 1
        self.off = np.searchsorted(self.d, np.arange(self.rows + 1))
        self.size = np.diff(self.off)
        self.ids = self.table.column(0)

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums over each set that tell sets apart."""
        out = []
        for salt in (0x51, 0xA7):
            t = np.zeros(len(self.g) + 1, U64)
            np.cumsum(mix(self.g ^ mix(np.array([salt], U64))), out=t[1:])
            out.append(mix(t[self.off[1:]] - t[self.off[:-1]] + self.size.astype(U64)))
        return out[0], out[1]

    def copies(self):
        """Both signatures of the distinct sets, in order, each document's set (empty sets too), and the smallest id of each."""
        a, b = self.signatures()
        number, first = P.numbered(_swap(a), b)
        low = np.full(len(first), P.NULL_ID)
        np.minimum.at(low, number, np.asarray(self.ids.fill_null(P.NULL_ID)))
        return _swap(a)[first], b[first], number, low

    def first_of_copies(self, replies, ranges: int) -> np.ndarray:
        """Documents that stand for their set: the smallest id, the first row of those."""
        keys, _, inv, low = self.copies()
        elsewhere = P.bits_of(replies, P.edges(P.route(_swap(keys), ranges), ranges), 1)[0]
        ids = np.asarray(self.ids.fill_null(P.NULL_ID))
        mine = np.flatnonzero((ids == low[inv]) & ~elsewhere[inv] & (self.size > 0))
        first = np.full(len(keys), -1)
        first[inv[mine][::-1]] = mine[::-1]
        out = np.zeros(self.rows, bool)
        out[first[first >= 0]] = True
        return out

    def shingle_keys(self, use: np.ndarray, buckets: int):
        """Sorted distinct keys of the used documents' shingles, each shingle's key, and how many sets hold it."""
        of = use[self.d]
        keys, inv, n = np.unique(P.short_keys(self.g[of], buckets), return_inverse=True, return_counts=True)
        return of, keys, inv, n


def _sequence(h: np.ndarray) -> np.uint64:
    x = np.array([0x5EED], U64)
    for w in h:
        x = mix((x ^ w) * U64(0x9FB21C651E98DF25) + U64(1))
    return x[0]


def _swap(k: np.ndarray) -> np.ndarray:
    return (k << U64(32)) | (k >> U64(32))



def answer_copies(keys, extra):
    """Whether another chunk holds the set under a smaller id (or an equal one, in an earlier row)."""
    lists = [P.unpack(k, 48) for k in keys]
    beside = [P._unzip(x, 2 * len(k), np.int64) for x, k in zip(extra, lists)]  # smallest ids, then second signatures

    def judge(k, ids, second):
        inv, distinct = P.numbered(k, second)
        low = np.full(len(distinct), P.NULL_ID)
        np.minimum.at(low, inv, ids)
        first = np.full(len(distinct), len(inv))
        mine = np.flatnonzero(ids == low[inv])
        first[inv[mine][::-1]] = mine[::-1]
        return first[inv] != np.arange(len(inv))

    found = P.by_parts(judge, lists, [x[:len(k)] for x, k in zip(beside, lists)], [x[len(k):] for x, k in zip(beside, lists)])
    return [np.packbits(other).tobytes() for other in found]


def answer_frequency(keys, extra):
    """Frequency class of each key: 0 for one set, else the power of two of the number of sets, plus one."""
    lists = [P.unpack(k, 16) for k in keys]

    def judge(k, sets):
        inv, n = P.key_groups(k)
        df = np.bincount(inv, weights=sets, minlength=n)
        return np.where(df > 1, np.floor(np.log2(np.maximum(df, 1))) + 1, 0).astype(np.uint8)[inv]

    return [P._zip(cls) for cls in P.by_parts(judge, lists, [P._unzip(x, len(k), np.uint32) for x, k in zip(extra, lists)])]


def prefix_sets(docs: DataFrame, n: int, num: int, den: int, chunk_bytes: int) -> DataFrame:
    """One row a document: (doc_id, size, sig1, sig2, lead, prefix, shared, odd).

    ``lead``: shingles of this set alone, which come first in the order; ``prefix``: the
    others of the prefix, in order; ``shared``: all shingles of more than one set, sorted, 8
    bytes each; ``odd``: their parities.  Only documents that stand for their set and have a prefix carry these."""
    chunks = P.write_chunks(docs, "chunks", chunk_bytes)
    ranges = P.bucket_count(chunks, 1 / 400)
    buckets = P.bucket_count(chunks, 1 / 6)

    def emit_copies(batches):
        for b in batches:
            for cid, body in zip(b.column(0).to_pylist(), b.column(1)):
                keys, second, _, low = Chunk(body.as_py(), n).copies()
                at = P.edges(P.route(_swap(keys), ranges), ranges)
                yield P.packed_rows(cid, [(i, P.pack(keys[a:z], 48), P._zip(np.concatenate([low[a:z], second[a:z].view(np.int64)]))) for i, (a, z) in enumerate(itertools.pairwise(at)) if z > a])

    def emit_shingles(batches):
        for b in batches:
            for cid, body, r in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                c = Chunk(body.as_py(), n)
                _, keys, _, df = c.shingle_keys(c.first_of_copies(r, ranges), buckets)
                at = P.edges(keys >> U64(32), buckets)
                yield P.packed_rows(cid, [(i, P.pack(keys[a:z] & U64(0xFFFFFFFF), 16), P._zip(df[a:z].astype(np.uint32)))
                                          for i, (a, z) in enumerate(itertools.pairwise(at)) if z > a])

    def emit_sets(batches):
        for b in batches:
            for body, r, f in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                c = Chunk(body.as_py(), n)
                use = c.first_of_copies(r, ranges)
                of, keys, inv, _ = c.shingle_keys(use, buckets)
                at = P.edges(keys >> U64(32), buckets)
                by_key = np.zeros(len(keys), np.uint8)
                for x in f or ():
                    a, z = int(at[x["bucket"]]), int(at[x["bucket"] + 1])
                    by_key[a:z] = P._unzip(x["reply"], z - a, np.uint8)
                cls = np.zeros(len(c.g), np.uint8)
                cls[of] = by_key[inv]
                s1, s2 = c.signatures()
                prefix, shared, lead, odd = [], [], [], []
                for i in range(c.rows):
                    a, z, size = int(c.off[i]), int(c.off[i + 1]), int(c.size[i])
                    k, g = cls[a:z], c.g[a:z]
                    many = k > 0
                    alone = size - int(many.sum())
                    room = size - -(-size * num // den) + 1 - alone
                    if not use[i] or room <= 0 or alone == size:
                        prefix.append(None), shared.append(None), lead.append(0), odd.append(None)
                        continue
                    g, k = g[many], k[many]
                    prefix.append(g[np.lexsort((g, k))[:room]].astype(np.int64).tolist())
                    shared.append(g.tobytes())
                    lead.append(alone)
                    odd.append(parities(g))
                yield pa.RecordBatch.from_arrays(
                    [c.ids.combine_chunks(), pa.array(c.size, pa.int64()), pa.array(s1.astype(np.int64)), pa.array(s2.astype(np.int64)),
                     pa.array(lead, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(shared, pa.binary()), pa.array(odd, pa.list_(pa.int64()))],
                    names=["doc_id", "size", "sig1", "sig2", "lead", "prefix", "shared", "odd"])

    copies = write_scratch(P.ask(map_arrow(chunks.select("chunk_id", "body"), emit_copies, P.PACKED), answer_copies), "copies")
    freq = P.ask(map_arrow(P.replies_by(chunks, copies=copies), emit_shingles, P.PACKED), answer_frequency)
    return write_scratch(map_arrow(P.replies_by(chunks, copies=copies, freq=freq), emit_sets,
                                   "doc_id long, size long, sig1 long, sig2 long, lead long, prefix array<long>, shared binary, odd array<long>"), "sets")


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough."""
    def run(batches):
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            keep = []
            for i, (_, _, m, k, x, y) in enumerate(zip(*cols)):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                if den * both >= num * (m + k - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    x = sets.select(F.col("doc_id").alias("x"), F.col("size").alias("m"), F.col("shared").alias("set_a"))
    y = sets.select(F.col("doc_id").alias("y"), F.col("size").alias("k"), F.col("shared").alias("set_b"))
    rows = (pairs.join(x, F.col("a") == F.col("x")).join(y, F.col("b") == F.col("y"))
            .select("a", "b", "m", "k", "set_a", "set_b"))
    return map_arrow(rows, run, "a long, b long")


LEADER_ROUNDS = 2
ODD = [f"odd{i}" for i in range(PARITIES // 64)]
SAME = [f"same{i}" for i in range(PARITIES // 64)]


def differing() -> Column:
    """The least number of shingles in which a pivot's set and each set of a group differ.

    Those of one set alone, and the parities apart among those that the group's sets have in common."""
    apart = [F.bit_count(F.col(f"p_{o}").bitwiseXOR(F.col(o)).bitwiseAND(F.col(s))) for o, s in zip(ODD, SAME)]
    return sum(apart, F.col("p_lead") + F.col("lead"))


def place_of(doc: Column, turn: int = 0) -> Column:
    """A document's place among others, from 0 to 1, by a hash: the same under every shingle."""
    return F.shiftrightunsigned(F.xxhash64(doc, F.lit(turn)), 11) / F.lit(float(1 << 53))


def near_groups(hits: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``hits`` (p_group, group) whose prefixes allow the similarity.

    The first shingle that both prefixes hold is the first that both sets hold, so their overlap is at most
    what either has from there on.  Prefixes come as 4-byte hashes: two that meet by chance only let a pair through."""
    short = F.transform("prefix", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    g = lambda c: groups.select(F.col("group").alias(f"{c}g"), F.col("size").alias(f"{c}size"), F.col("lead").alias(f"{c}lead"), short.alias(f"{c}prefix"))
    rows = hits.join(g("p_"), F.col("p_group") == F.col("p_g")).join(g("t_"), F.col("group") == F.col("t_g"))
    rest = lambda c: F.col(f"{c}size") - F.col(f"{c}lead") - F.array_position(F.col(f"{c}prefix"), F.col("first")) + 1
    need = F.ceil((F.col("p_size") + F.col("t_size")) * num / (num + den))
    first = F.get(F.array_intersect("p_prefix", "t_prefix"), F.lit(0))
    return rows.withColumn("first", first).where(F.least(rest("p_"), rest("t_")) >= need).select("p", "p_label", "group")


def linked_sets(sets: DataFrame, num: int, den: int, pivots: int = 4) -> DataFrame:
    """(doc_id, label) of different sets: the smallest doc_id that links reach.

    After each round the new links are contracted to links between labels, so a round's
    work on components follows its own links only."""
    sets = sets.where("prefix is not null and doc_id is not null")
    members = sets.select("doc_id", "size", "lead", F.xxhash64("size", "lead", "prefix").alias("group"), "prefix",
                          *[F.get("odd", F.lit(i)).alias(c) for i, c in enumerate(ODD)])
    groups = write_scratch(members.groupBy("group").agg(
        *[F.first(c).alias(c) for c in ("size", "lead", "prefix")], *[F.bit_and(c).alias(c) for c in ODD],
        *[F.bitwise_not(F.bit_and(c).bitwiseXOR(F.bit_or(c))).alias(s) for c, s in zip(ODD, SAME)]), "groups")
    members = write_scratch(members.select("doc_id", "group", place_of(F.col("doc_id")).alias("place"), *ODD), "members")
    odd_of = members.select(F.col("doc_id").alias("o_doc"), *[F.col(c).alias(f"p_{c}") for c in ODD])
    odd_in = groups.select(F.col("group").alias("o_group"), "lead", *ODD, *SAME)
    members = members.drop(*ODD)
    # A shared shingle has ``at`` shared ones before it and at most ``rest`` from it on.
    open_ = groups.select(F.posexplode("prefix").alias("at", "token"), "group", "size", "lead", "prefix")
    open_ = open_.select("token", "group", "size", "at", (F.col("size") - F.col("lead") - F.col("at")).alias("rest"),
                         F.get("prefix", F.col("at") - 1).alias("prev"))
    state = members.select("doc_id", F.col("doc_id").alias("label"))
    counted, done, upto = False, 0, 0  # pivots under each shingle: those up to ``done`` are done with
    for turn in itertools.count():
        leading = turn < LEADER_ROUNDS
        state = write_scratch(state, "state")
        labels = members.join(state.withColumnRenamed("doc_id", "s_doc"), F.col("doc_id") == F.col("s_doc")).drop("s_doc")
        under = open_.join(labels.withColumnRenamed("group", "m_group"), F.col("group") == F.col("m_group")).drop("m_group")
        if not counted:  # a shingle's number of documents stays beside it
            n = under.groupBy(F.col("token").alias("t")).agg(F.count(F.lit(1)).alias("n"))
            open_ = open_.join(n.where("n > 1"), F.col("token") == F.col("t")).drop("t")
            under = under.join(n.where("n > 1"), F.col("token") == F.col("t")).drop("t")
            counted = True
        # Shingles under which documents of more than one component are left.
        left = F.col("place") * F.col("n") >= done
        span = under.where(left).groupBy(F.col("token").alias("t")).agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct(place_of(F.col("doc_id"), turn), "doc_id")).alias("leader"))
        span = span.where("low <> high").select("t", "leader")
        under = write_scratch(under.join(span, F.col("token") == F.col("t")).drop("t"), "open")
        if not under.limit(1).collect():
            return state
        light = ["token", "group", "size", "at", "rest", "prev"]
        open_ = under.select(*light, "n").distinct()
        # Pivots: in the first rounds one document under each shingle, then ever more.
        pivot = F.col("doc_id") == F.col("leader.doc_id") if leading else left & (F.col("place") * F.col("n") < upto)
        chosen = under.where(pivot).select("token", F.col("doc_id").alias("p"), F.col("label").alias("p_label"), *[F.col(c).alias(f"p_{c}") for c in light[1:]])
        # Probe: groups under the same shingle that hold another component, by sizes and places.
        # Documents done with have met all others there.
        target = under.where(left).groupBy(F.col("token").alias("t"), *light[1:]).agg(F.min("label").alias("low"), F.max("label").alias("high"))
        need = F.ceil((F.col("p_size") + F.col("size")) * num / (num + den))
        may = ((F.col("token") == F.col("t")) & ((F.col("low") != F.col("p_label")) | (F.col("high") != F.col("p_label")))
               & (F.col("p_size") * den >= F.col("size") * num) & (F.col("size") * den >= F.col("p_size") * num)
               & (F.least("p_at", "at") + F.least("p_rest", "rest") >= need))
        if not leading:  # sets that share the shingle before this one too meet there
            may = may & F.coalesce(F.col("p_prev") != F.col("prev"), F.lit(True)) & (differing() <= F.col("p_size") + F.col("size") - 2 * need)
            chosen = chosen.join(odd_of, F.col("p") == F.col("o_doc")).withColumn("p_lead", F.col("p_size") - F.col("p_rest") - F.col("p_at"))
            target = target.join(odd_in, F.col("group") == F.col("o_group"))
        hits = chosen.join(target, may).groupBy("p", "p_group", "p_label", "group").agg(F.count(F.lit(1)).alias("shared"))
        if leading:  # each group with one leader only: the one of most of its shingles
            best = F.max(F.struct("shared", place_of(F.col("p"), turn), "p", "p_group", "p_label")).alias("best")
            hits = hits.groupBy("group").agg(best).select("group", "best.p", "best.p_group", "best.p_label")
        hits = near_groups(hits, groups, num, den)
        # Expand to members in another component; two pivots meet once.
        pairs = (hits.withColumnRenamed("group", "h_group").join(labels, F.col("h_group") == F.col("group"))
                 .where(F.col("p_label") != F.col("label")))
        pairs = pairs.select(F.least("p", "doc_id").alias("a"), F.greatest("p", "doc_id").alias("b")).distinct()
        new = write_scratch(verify(pairs, sets, num, den), "verified")
        if new.limit(1).collect():
            of = lambda c: state.select(F.col("doc_id").alias(f"{c}_doc"), F.col("label").alias(f"{c}_label"))
            between = (new.join(of("a"), F.col("a") == F.col("a_doc")).join(of("b"), F.col("b") == F.col("b_doc"))
                       .select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
            label = components(between).withColumnsRenamed({"v": "c", "label": "c_label"})
            state = state.join(label, F.col("label") == F.col("c"), "left").select("doc_id", F.coalesce("c_label", "label").alias("label"))
        if not leading or turn == LEADER_ROUNDS - 1:
            done, upto = upto, upto * 4 or pivots


def ngram_join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, chunk_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    sets = prefix_sets(docs, n, num, den, chunk_bytes)
    same = (sets.where("size > 0 and doc_id is not null").groupBy("sig1", "sig2", "size").agg(F.min("doc_id").alias("rep"))
            .withColumnsRenamed({"sig1": "r1", "sig2": "r2", "size": "r_size"}))
    reached = linked_sets(sets, num, den).withColumnRenamed("doc_id", "v")
    out = (sets.select("doc_id", "size", "sig1", "sig2")
           .join(same, (F.col("sig1") == F.col("r1")) & (F.col("sig2") == F.col("r2")) & (F.col("size") == F.col("r_size")), "left")
           .join(reached, F.col("rep") == F.col("v"), "left"))
    return out.select("doc_id", F.col("size").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id")).alias("component_id"))


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    return ngram_join(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT d.doc_id, count(s.s) AS n FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(reach.y)::BIGINT AS component_id FROM n JOIN reach ON reach.x = n.doc_id GROUP BY 1, 2
"""
