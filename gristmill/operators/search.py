"""Ranked retrieval: BM25 over postings, exact vector search in blocks, rank fusion, reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from gristmill.functions.text import has_term, holds, padded, tokens
from gristmill.scratch import staged

K1, B, RRF_K = 1.5, 0.75, 60
QUERY_BLOCK_BYTES = 32 << 20
VOCABULARY_BYTES = 32 << 20  # of asked terms that every task may hold
COMMON = 0.01  # share of the documents above which a term is a common one
GAINS_BLOCK = 1 << 19  # terms of queries that every task may hold
SENT_TERMS = 1 << 20  # terms asked of documents that every task may hold
CELLS = 4 << 20  # numbers in a task's tables


def top_k(scored: DataFrame, k: int, query: str = "query_id", key: str = "doc_id", score: str = "score") -> DataFrame:
    """The ``k`` best by score to six places, ties by key, with their rank from 1."""
    order = Window.partitionBy(query).orderBy(F.desc(score), F.col(key))
    return scored.withColumn(score, F.round(score, 6)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass
class Index:
    """``found``: ``doc, terms, weights``, a row for each key that holds asked terms. ``gains``: ``query_id, term, gain, df``. ``n``: all documents.

    ``rows``: the ``postings``, a row for each document.
    """

    found: DataFrame
    rows: DataFrame
    gains: DataFrame
    n: int


def postings(docs: DataFrame, words: Column, terms: DataFrame, key: str = "doc_id", most_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """``doc, length, terms, tfs``: for each document the asked ``terms`` it holds and how often, written to the shared folder.

    Texts are taken apart once, and only the asked terms leave the task. The terms go out whole where they are small enough,
    else the documents' words are joined to them. Both ways give the same rows.
    """
    spark = terms.sparkSession
    read = docs.select(F.col(key).alias("doc"), F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    asked = terms.select("term").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()[0]
    if size > most_bytes:
        mark = spark.createDataFrame([("",)], "term string")  # of its own for each document, so that none goes missing
        # the length is worked out before the words become rows, or it would be once for every row
        sized = read.select(F.struct(F.monotonically_increasing_id().alias("at"), "doc").alias("doc"), F.size("words").alias("length"), F.array_append("words", F.lit("")).alias("terms"))
        each = sized.select("doc", "length", F.explode("terms").alias("term")).join(asked.unionByName(mark), "term", "left_semi")
        each = each.groupBy("doc", "length", "term").agg(F.count("*").cast("int").alias("tf"))
        listed = each.groupBy("doc", "length").agg(F.collect_list(F.when(F.col("term") != "", F.struct("term", "tf"))).alias("t"))
        return staged(listed.select("doc.doc", "length", F.col("t.term").alias("terms"), F.col("t.tf").alias("tfs")), "postings")
    shared = spark.sparkContext.broadcast(sorted(r["term"] for r in asked.collect()))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, "string")
        for batch in batches:
            said = batch.column("words")
            at = pc.index_in(said.flatten(), known)
            row = pc.list_parent_indices(said).filter(at.is_valid()).to_numpy().astype("int64")
            both, tf = np.unique(row * len(known) + at.drop_null().to_numpy(), return_counts=True)
            row, term = np.divmod(both, max(1, len(known)))
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), "int32")
            lists = [pa.ListArray.from_arrays(ends, v) for v in (known.take(pa.array(term)), pa.array(tf, "int32"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pc.list_value_length(said), *lists], ["doc", "length", "terms", "tfs"])

    return staged(read.mapInArrow(pick, f"doc {read.schema['doc'].dataType.simpleString()}, length int, terms array<string>, tfs array<int>"), "postings")


def index(queries: DataFrame, docs: DataFrame, words: Column, key: str = "doc_id", most_bytes: int = VOCABULARY_BYTES) -> Index:
    """What BM25 needs of the documents for the terms of ``queries`` (``query_id, text``); ``words`` are a document's tokens.

    A term repeated in a query counts as often. Documents without tokens count for number and mean length, null ones too; the
    rows of a key that comes repeatedly are added up, those of one length as one text, as grouping by key and length does.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    kept = postings(docs, words, asked, key, most_bytes)
    n, mean = kept.agg(F.count("*"), F.avg("length")).first()
    weigh = lambda tf: tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * F.col("length") / F.lit(mean or 1.0)))
    if kept.groupBy("doc").count().filter("count > 1").isEmpty():
        found = kept.filter(F.size("terms") > 0).select("doc", "terms", F.transform("tfs", weigh).alias("weights"))
        df = kept.select(F.explode("terms").alias("term"))
    else:
        each = kept.select("doc", "length", F.inline(F.arrays_zip("terms", "tfs"))).groupBy("doc", "length", F.col("terms").alias("term")).agg(F.sum("tfs").alias("tf"))
        df = each = staged(each, "repeated")
        each = each.groupBy("doc", "term").agg(F.sum(weigh(F.col("tf"))).alias("weight")).groupBy("doc").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
        found = staged(each.select("doc", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "found")
    df = df.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return Index(found, kept, staged(asked.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("gain"), "df"), "gains"), n)


def bm25(queries: DataFrame, docs: DataFrame, words: Column, key: str = "doc_id") -> DataFrame:
    """``query_id, key, score`` of every document that shares a term with a query, see ``index``.

    As many rows as there are such pairs; for the best of each query ``bm25_top_k`` does without them. A query without known terms finds nothing.
    """
    of = index(queries, docs, words, key)
    each = of.found.select("doc", F.inline(F.arrays_zip("terms", "weights"))).select("doc", F.col("terms").alias("term"), F.col("weights").alias("weight"))
    scored = each.join(of.gains, "term").groupBy("query_id", F.col("doc").alias(key)).agg(F.sum(F.col("gain") * F.col("weight")).alias("score"))
    return scored.filter("score > 0")


def bm25_top_k(queries: DataFrame, docs: DataFrame, words: Column, k: int, key: str = "doc_id") -> DataFrame:
    """``query_id, key, score, rank``: what ``top_k`` of ``bm25`` gives."""
    return ranked(index(queries, docs, words, key), k, key)


def ranked(of: Index, k: int, key: str = "doc_id", common: float = COMMON, block: int = GAINS_BLOCK) -> DataFrame:
    """``query_id, key, score, rank``: the ``k`` best documents by BM25, exactly, without scoring every pair.

    Terms in more than the share ``common`` of the documents are common ones. Queries with the same common terms share the list of
    the documents that are best by these alone (``k`` long, few such lists). A document with none of a query's rare terms is
    among its best only if it stands in that list, as every score is at least its common part; those with a rare term are few and
    are scored in full. Queries go out in blocks of at most about ``block`` terms.
    """
    spark = of.found.sparkSession
    blocks = max(1, math.ceil(of.gains.count() / block))
    doc_type, query_type = of.found.schema["doc"].dataType.simpleString(), of.gains.schema["query_id"].dataType.simpleString()

    def block_of(i: int) -> DataFrame:
        part = of.gains.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("query_id", "term").toArrow()
        asked = _Block(part, common * of.n)
        sent = spark.sparkContext.broadcast(asked)
        rows = of.found.mapInArrow(lambda batches: sent.value.best(batches, k), f"query_id {query_type}, {key} {doc_type}, score double, shared boolean")
        rows = staged(rows, "scores")
        lists = top_k(rows.filter("shared"), k, key=key).withColumnRenamed("query_id", "head")
        heads = spark.createDataFrame(asked.heads(part.schema.field("query_id").type), f"head {query_type}, query_id {query_type}")
        shared = lists.join(heads, "head").select("query_id", key, "score")
        # a document may come both ways: the full score is the larger
        return rows.filter("not shared").select("query_id", key, "score").unionByName(shared).groupBy("query_id", key).agg(F.max("score").alias("score"))

    found = block_of(0)
    for i in range(1, blocks):
        found = found.unionByName(block_of(i))
    return top_k(found, k, key=key)


class _Block:
    """Some queries' terms as arrays: the common ones of each list, the queries of each rare one."""

    def __init__(self, gains: pa.Table, most: float):
        ids = gains.column("query_id").combine_chunks().dictionary_encode()
        self.ids, query = ids.dictionary, ids.indices.to_numpy(zero_copy_only=False)
        gain, is_common = gains.column("gain").to_numpy(), gains.column("df").to_numpy() > most
        terms = gains.column("term").combine_chunks()
        common, rare = (terms.filter(pa.array(m)).dictionary_encode() for m in (is_common, ~is_common))
        self.terms, self.n_common = [*common.dictionary.to_pylist(), *rare.dictionary.to_pylist()], len(common.dictionary)
        # the list of each query (-1: it has no common term); a list is its terms and gains, and is named by its first query
        each: dict[int, list] = {}
        for q, t, g in zip(query[is_common].tolist(), common.indices.to_numpy(zero_copy_only=False).tolist(), gain[is_common].tolist()):
            each.setdefault(q, []).append((t, g))
        numbers: dict[tuple, int] = {}
        self.list_of, self.first = np.full(len(self.ids), -1), []
        for q, of in each.items():
            if (at := numbers.setdefault(tuple(of), len(numbers))) == len(self.first):
                self.first.append(q)
            self.list_of[q] = at
        self.lists = [(np.array([t for t, _ in of]), np.array([g for _, g in of])) for of in numbers]
        # the queries of rare term t are those from ends[t] to ends[t + 1]
        t = rare.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(t, kind="stable")
        self.ends = np.searchsorted(t[order], np.arange(len(rare.dictionary) + 1))
        self.query, self.gain = query[~is_common][order], gain[~is_common][order]

    def heads(self, kind: pa.DataType) -> pa.Table:
        asked = np.flatnonzero(self.list_of >= 0)
        head = np.array(self.first, dtype="int64")[self.list_of[asked]]
        return pa.table({"head": self.ids.take(pa.array(head)).cast(kind), "query_id": self.ids.take(pa.array(asked)).cast(kind)})

    def best(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """``query_id, doc, score, shared`` of a task's documents: the best of each list under its first query; by query those with a rare term."""
        known, lists = pa.array(self.terms, "string"), [None] * len(self.lists)
        least = np.zeros(len(self.lists) + 1)  # what a further document needs for a list; the last is of queries without one
        step = max(1, CELLS // max(1, self.n_common))
        kind = None
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                doc, kind, keys = part.column("doc"), batch.schema.field("doc").type, _keys(part.column("doc"))
                at = pc.index_in(part.column("terms").flatten(), known)
                row = pc.list_parent_indices(part.column("terms")).filter(at.is_valid()).to_numpy()
                weight = part.column("weights").flatten().filter(at.is_valid()).to_numpy()
                at = at.drop_null().to_numpy()
                held, often = np.zeros((self.n_common, part.num_rows)), at < self.n_common
                held[at[often], row[often]] = weight[often]
                for i, (terms, gains) in enumerate(self.lists):
                    score = _summed(gains[:, None] * held[terms])
                    hit = np.flatnonzero((score > 0) & (score >= least[i]))
                    if len(hit) > k:
                        hit = hit[score[hit] >= np.partition(score[hit], -k)[-k] - 1e-6]
                    if len(hit):
                        s, d = score[hit], keys[hit]
                        if lists[i]:
                            s, d = np.concatenate([lists[i][0], s]), np.concatenate([lists[i][1], d])
                        top = _order(s, d)[:k]
                        lists[i] = s[top], d[top]
                        if len(top) == k:
                            least[i] = s[top].min() - 1e-6  # equal when rounded must still come in
                yield from self._rare(doc, keys, at[~often] - self.n_common, row[~often], weight[~often], held, least, k)
        for i, of in enumerate(lists):
            if of:
                yield self._rows(np.full(len(of[0]), self.first[i]), pa.array(of[1].tolist(), kind), of[0], True)

    def _rows(self, query: np.ndarray, doc: pa.Array, score: np.ndarray, shared: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(query)), doc, pa.array(score), pa.array(np.full(len(score), shared))], ["query_id", "doc", "score", "shared"])

    def _rare(self, doc, keys, term, row, weight, held, least, k) -> Iterator[pa.RecordBatch]:
        count = self.ends[term + 1] - self.ends[term]
        # so many postings at a time that their pairs fit; a document's stay together, as they come by row
        pairs = np.bincount(row, count, held.shape[1]).cumsum() // CELLS
        for cut in np.unique(pairs[row]):
            some = pairs[row] == cut
            n = count[some]
            where = np.repeat(self.ends[term[some]] - n.cumsum() + n, n) + np.arange(n.sum())
            both, at = np.unique(self.query[where].astype("int64") * held.shape[1] + np.repeat(row[some], n), return_inverse=True)
            score = np.bincount(at, self.gain[where] * np.repeat(weight[some], n), len(both))
            query, docs = np.divmod(both, held.shape[1])
            lists = self.list_of[query]
            for i in np.unique(lists[lists >= 0]):
                of, (terms, gains) = np.flatnonzero(lists == i), self.lists[i]
                score[of] += _summed(gains[:, None] * held[terms[:, None], docs[of]])
            may = np.flatnonzero(score >= least[lists])  # below it, the task's list alone has k better ones
            query, docs, score = query[may], docs[may], score[may]
            order = np.lexsort((_places(keys)[docs], -np.round(score, 6), query))
            place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            top = order[place < k]
            yield self._rows(query[top], doc.take(pa.array(docs[top])), score[top], False)


def _summed(parts: np.ndarray) -> np.ndarray:
    """The sum over the first axis, always in the same order, so that equal documents get equal sums wherever they stand."""
    total = parts[0].copy()
    for part in parts[1:]:
        total += part
    return total


def _keys(column: pa.Array) -> np.ndarray:
    return column.to_numpy() if pa.types.is_integer(column.type) and not column.null_count else np.array([*column.to_pylist(), None], dtype=object)[:-1]


def _places(keys: np.ndarray) -> np.ndarray:
    """The place of each key in their order, null first."""
    order = np.argsort(keys, kind="stable") if keys.dtype != object else np.array(sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i])), dtype="int64")
    place = np.empty(len(keys), dtype="int64")
    place[order] = np.arange(len(keys))
    return place


def _order(score: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions by score to six places, ties by key."""
    return np.lexsort((_places(keys), -np.round(score, 6)))


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding",
                 block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """``query_id, key, score, rank`` by dot product over all vectors; ``queries`` has ``query_id, vector``.

    The queries go out in blocks of bounded size; each task keeps the best of its batches, and the
    best of those are ranked. Null vectors and vectors of another length than a query's are no
    candidates.
    """
    spark = vectors.sparkSession
    queries = queries.filter("vector is not null and size(vector) > 0")
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    blocks = max(1, math.ceil(n * width * 8 / block_bytes))
    key_type, query_type = vectors.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, {key} {key_type}, score double"
    slim = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))

    def block_of(i: int) -> DataFrame:
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        shared = spark.sparkContext.broadcast([(r["query_id"], np.asarray(r["vector"], dtype="float64")) for r in rows])

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                by_width: dict[int, list[int]] = {}
                for at, v in enumerate(batch["vector"]):
                    by_width.setdefault(len(v), []).append(at)
                for width, at in by_width.items():
                    asked = [(q, v) for q, v in shared.value if len(v) == width]
                    if not asked:
                        continue
                    keys = batch["key"].to_numpy()[at]
                    scores = np.round(np.stack([v for _, v in asked]) @ np.stack(batch["vector"].iloc[at].to_list()).astype("float64").T, 6)
                    for (q, _), row in zip(asked, scores):
                        best = np.lexsort((keys, -row))[:k]
                        yield pd.DataFrame({"query_id": q, key: keys[best], "score": row[best]})

        return slim.mapInPandas(scan, schema)

    found = block_of(0)
    for i in range(1, blocks):
        found = found.unionByName(block_of(i))
    return top_k(found, k, key=key)


def fuse(lanes: list[tuple[str, float, DataFrame]], key: str = "doc_id") -> DataFrame:
    """``query_id, key, score, lanes``: weighted reciprocal rank fusion of (name, weight, ranked lane)."""
    rows = None
    for name, weight, lane in lanes:
        part = lane.select("query_id", key, F.lit(name).alias("lane"), (F.lit(float(weight)) / (F.lit(float(RRF_K)) + F.col("rank"))).alias("share"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query_id", key).agg(F.sum("share").alias("score"), F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("lanes"))


def overlap(query: Column, text: Column) -> Column:
    """Share of a query's distinct tokens that a text holds."""
    asked = F.array_distinct(tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, tokens(text))).cast("double"), F.size(asked)), F.lit(0.0))


def overlaps(of: Index, queries: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``query_id, key, score``: ``overlap`` of the ``found`` pairs with the ``queries`` of the index, by its postings and without the texts."""
    asked = found.select("query_id", key).join(queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("asked")), "query_id")
    both = asked.join(of.rows.select(F.col("doc").alias(key), "terms"), key)
    share = F.try_divide(F.size(F.array_intersect("asked", F.coalesce("terms", F.array().cast("array<string>")))).cast("double"), F.size("asked"))
    return both.select("query_id", key, F.coalesce(share, F.lit(0.0)).alias("score"))


def coverage(evidence: DataFrame, terms: str, text: str, query: str = "query_id") -> DataFrame:
    """``query, n_terms, n_present, covered``: share of each query's terms that some of its evidence holds."""
    each = evidence.select(query, F.explode(F.col(terms)).alias("term"), text)
    seen = each.groupBy(query, "term").agg(F.max(has_term(F.col(text), F.col("term")).cast("int")).alias("seen"))
    return _covered(seen, query)


def coverage_of(found: DataFrame, asked: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", most_terms: int = SENT_TERMS) -> DataFrame:
    """``coverage`` of the queries (``asked``: ``query_id, terms``) by the ``docs`` that were ``found`` for them (``query_id, key``).

    Each text is looked through once, for all terms asked of it. These go out to the texts where they are few enough, so that the texts stay
    in their tasks, else both are joined by key. Both ways give the same rows.
    """
    each = staged(found.select("query_id", key).join(asked, "query_id").select("query_id", key, F.explode("terms").alias("term")), "evidence")
    wanted = staged(each.groupBy(key).agg(F.collect_set("term").alias("terms")), "wanted")
    few = wanted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] <= most_terms
    texts = docs.select(key, text).join(F.broadcast(wanted) if few else wanted, key).select(key, padded(F.col(text)).alias("padded"), "terms")
    # the text is padded before the terms become rows, or it would be once for every row
    hits = texts.select(key, "padded", F.explode("terms").alias("term")).select(key, "term", holds(F.col("padded"), F.col("term")).cast("int").alias("seen"))
    return _covered(each.join(hits, [key, "term"]).groupBy("query_id", "term").agg(F.max("seen").alias("seen")), "query_id")


def _covered(seen: DataFrame, query: str) -> DataFrame:
    return seen.groupBy(query).agg(F.count("*").alias("n_terms"), F.sum("seen").alias("n_present"), F.round(F.avg("seen"), 6).alias("covered"))


def first_seen(ranked: DataFrame, unit: str, parent: str, k: int) -> DataFrame:
    """Ranks of parents by their best unit."""
    best = ranked.groupBy("query_id", parent).agg(F.min("rank").alias("best"))
    order = Window.partitionBy("query_id").orderBy("best", parent)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), key: str = "doc_id") -> DataFrame:
    """``n_queries, recall_at_K..., mrr`` over the queries that have gold (``query_id, key``).

    A query counts for recall at K only if all its gold is among its first K; the reciprocal rank is
    that of the first gold within the largest K, else 0.
    """
    deepest = max(ks)
    joined = gold.distinct().join(ranked.filter(F.col("rank") <= deepest).select("query_id", key, "rank"), ["query_id", key], "left")
    per = joined.groupBy("query_id").agg(
        F.count("*").alias("n_gold"), F.min("rank").alias("first"),
        *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"in_{k}") for k in ks],
    )
    recalls = [F.round(F.avg((F.col(f"in_{k}") == F.col("n_gold")).cast("double")), 6).alias(f"recall_at_{k}") for k in ks]
    return per.agg(F.count("*").alias("n_queries"), *recalls, F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def floor_union(sure: DataFrame, reranked: DataFrame, floor: int, k: int, key: str = "doc_id") -> DataFrame:
    """``query_id, key, rank, lane``: the first ``floor`` of ``sure``, then ``reranked``, each once in that order, ``k`` at most.

    So reranking never loses what the first lane was sure of. Both have ``query_id, key, rank``.
    """
    part = lambda df, turn, lane: df.select("query_id", key, F.struct(F.lit(turn).alias("turn"), "rank").alias("at"), F.lit(lane).alias("lane"))
    both = part(sure.filter(F.col("rank") <= floor), 0, "floor").unionByName(part(reranked, 1, "reranked"))
    once = both.groupBy("query_id", key).agg(F.min(F.struct("at", "lane")).alias("m"))
    order = Window.partitionBy("query_id").orderBy("m.at", key)
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", key, "rank", F.col("m.lane").alias("lane"))


def best_branch(branches: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """``query_id, key, score``: the best score that any branch (``query_id, key, score``) gives."""
    rows = branches[0]
    for branch in branches[1:]:
        rows = rows.unionByName(branch)
    return rows.groupBy("query_id", key).agg(F.max("score").alias("score"))
