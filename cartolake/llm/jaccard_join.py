"""N-gram Jaccard join: near-duplicate documents by their sets of word shingles.

A grouped prefix join. Shingles are ordered by how many documents have them, and the first of
each set, enough that two similar sets must share one, are its prefix; shingles that no other
document has can't be shared and are not joined. Equal sets form a class, classes of equal
prefix and size a group. Groups meet through prefix shingles under length and position bounds;
members of group pairs are verified by their whole sets.

To find components without all pairs, each shingle's list first verifies against one leader:
the class whose shingles are most common. What then still spans two components is
verified pair by pair, so no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm.blocks import SpanHashes, block_rows, counts_of, key_counts, mixed, n_buckets, text_bytes
from cartolake.llm.common import SPACES, WORD, saved, table
from cartolake.llm.components import components

WORDS, PERCENT = 5, 80
#: Members that one task verifies against a class at once.
MEMBERS = 256
#: Entries of a shingle's list that one task pairs with its strays.
LIST = 1024

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: pa.ChunkedArray | pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each text, sorted by both.

    Words are runs of bytes that aren't white space, A-Z lower-cased. A text of fewer words is one
    shingle, one without words has none.
    """
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[:-1] = space
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    before = np.ones(len(data), dtype=bool)
    before[1:] = space[:-1]
    start = np.flatnonzero(~space & (before | begins[:-1]))
    end = np.flatnonzero(~space & (edge[1:] | begins[1:])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    word = SpanHashes(data).of(start, end)
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    m = len(word)
    hashed = np.zeros(m, dtype=np.uint64)
    for k in range(words):
        hashed[: max(0, m - k)] = mixed(hashed[: max(0, m - k)] * np.uint64(0x9FB21C651E98DF25) + word[k:])
    whole = np.arange(m) + words <= np.cumsum(n_words)[doc] if m else np.zeros(0, dtype=bool)
    docs, hashes = [doc[whole]], [hashed[whole]]
    first = np.cumsum(n_words) - n_words
    for n in range(1, words):
        few = np.flatnonzero(n_words == n)
        short = np.full(len(few), n, dtype=np.uint64)
        for k in range(n):
            short = mixed(short * np.uint64(0x9FB21C651E98DF25) + word[first[few] + k] + np.uint64(1))
        docs.append(few)
        hashes.append(short)
    d, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """One row for each document: id, text_hash, n, name (of its set), weight, prefix (token, place), prefix_name, members (its set, if it can be similar to another)."""
    rows, n_blocks = block_rows(docs, id_col, text_col)
    buckets = n_buckets(n_blocks)

    def keys(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(shingles(t.column("text"), words)[1], return_counts=True)

    def build(t: pa.Table, answers: pa.Table) -> pa.Table:
        n_docs = t.num_rows
        d, h = shingles(t.column("text"), words)
        distinct, at = np.unique(h, return_inverse=True)
        df = counts_of(distinct, buckets, answers)[at] if len(h) else np.zeros(0, dtype=np.int64)
        n = np.bincount(d, minlength=n_docs)
        end = np.cumsum(n)
        weight = np.bincount(d, weights=np.log2(np.maximum(df, 1)), minlength=n_docs) / np.maximum(n, 1)
        order = np.lexsort((h, df, d))
        place = np.arange(len(h)) - (end - n)[d]
        prefix_size = np.where(n > 0, n + (-percent * n // 100) + 1, 0)
        in_prefix = place < prefix_size[d]
        token, often = h[order][in_prefix], df[order][in_prefix] > 1
        p_end = np.cumsum(prefix_size)
        names, p_names, prefixes, sets = [], [], [], []
        signed = h.view(np.int64)
        with np.errstate(over="ignore"):
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(h + np.uint64(salt)))]) for salt in (1, 2)]
            p_sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(token + np.uint64(3)))])
            for i in range(n_docs):
                a, b = end[i] - n[i], end[i]
                names.append(b"".join(int(s[b] - s[a]).to_bytes(8, "big") for s in sums))
                x, y = p_end[i] - prefix_size[i], p_end[i]
                p_names.append(int(p_sums[y] - p_sums[x]).to_bytes(8, "big"))
                use = np.flatnonzero(often[x:y])
                prefixes.append([{"token": int(v), "place": int(j)} for v, j in zip(token[x:y][use].view(np.int64), use, strict=True)])
                sets.append(signed[a:b].astype("<i8").tobytes() if len(use) else None)
        return pa.table(
            {
                "id": t.column("id"),
                "text_hash": t.column("text_hash"),
                "n": pa.array(n, pa.int32()),
                "name": pa.array(names, pa.binary()),
                "weight": pa.array(weight, pa.float64()),
                "prefix_name": pa.array(p_names, pa.binary()),
                "prefix": pa.array(prefixes, pa.list_(pa.struct([("token", pa.int64()), ("place", pa.int32())]))),
                "members": pa.array(sets, pa.binary()),
            }
        )

    answers = key_counts(rows, keys, buckets)
    schema = "id long, text_hash long, n int, name binary, weight double, prefix_name binary, prefix array<struct<token:long,place:int>>, members binary"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(build, schema)


def _close(x: str, y: str, percent: int) -> Column:
    """Length and position bounds of two postings, for the first shingle that two sets share in order."""
    n_x, n_y = F.col(f"{x}.n"), F.col(f"{y}.n")
    rest = F.least(n_x - F.col(f"{x}.place"), n_y - F.col(f"{y}.place"))
    return (F.least(n_x, n_y) * 100 >= F.greatest(n_x, n_y) * percent) & (rest * (100 + percent) >= (n_x + n_y) * percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Each a comes once to each MEMBERS of its b's."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("salts"))
    dealt = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    # new names on either side, as both come from the pairs
    left = salts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).join(sets.select(F.col("name").alias("a"), "members"), "a")
    left = left.select(F.col("a").alias("l_a"), F.col("salt").alias("l_salt"), F.col("members").alias("l_members"))
    right = dealt.join(sets.select(F.col("name").alias("b"), "members"), "b")
    right = right.select(F.col("a").alias("r_a"), F.col("salt").alias("r_salt"), F.col("b").alias("r_b"), F.col("members").alias("r_members"))

    def verify(own: pa.Table, others: pa.Table) -> pa.Table:
        good = []
        if own.num_rows:
            x = np.frombuffer(own.column("l_members")[0].as_py(), dtype="<i8").view(np.uint64)
            for b, members in zip(others.column("r_b"), others.column("r_members"), strict=True):
                y = np.frombuffer(members.as_py(), dtype="<i8").view(np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                if both * 100 >= (len(x) + len(y) - both) * percent:
                    good.append(b.as_py())
        a = own.column("l_a")[0].as_py() if own.num_rows else None
        return pa.table({"a": pa.array([a] * len(good), pa.binary()), "b": pa.array(good, pa.binary())})

    return left.groupBy("l_a", "l_salt").cogroup(right.groupBy("r_a", "r_salt")).applyInArrow(verify, "a binary, b binary")


def _class_links(classes: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the classes (name, n, weight, prefix_name, prefix, members) that are linked."""
    groups = classes.groupBy("prefix_name", "n").agg(F.max(F.struct("weight", "name")).alias("top"), F.first("prefix").alias("prefix"), F.count("*").alias("size"))
    members = saved(classes.select("name", "n", "weight", "prefix_name"))
    posted = groups.select("prefix_name", "n", "size", F.col("top.weight").alias("weight"), F.col("top.name").alias("name"), F.explode("prefix").alias("p"))
    posted = saved(posted.select("prefix_name", "n", "size", "weight", "name", "p.token", "p.place"))
    leaders = posted.groupBy("token").agg(F.max(F.struct("weight", "name", "n", "place", "prefix_name")).alias("l"), F.sum("size").alias("all")).filter("all > 1")
    leaders = saved(leaders.select("token", "l.*"))
    near = posted.alias("x").join(leaders.alias("y"), "token").filter(_close("x", "y", percent))
    group_pairs = near.select(F.col("y.name").alias("a"), F.col("x.prefix_name").alias("prefix_name"), F.col("x.n").alias("n")).distinct()
    first = group_pairs.join(members, ["prefix_name", "n"]).filter("a <> name").select("a", F.col("name").alias("b"))
    sets = classes.select("name", "members")
    links = saved(_verified(first, sets, percent))
    label = components(links)
    # lists that still hold two components: their postings outside the component of the leader meet the others
    labelled = members.join(label, F.col("name") == F.col("node"), "left").select("name", "n", "prefix_name", F.coalesce("label", "name").alias("label"))
    labelled = saved(labelled)
    # members of a group in one component are one unit; units are paired and filtered, and only then expanded
    units = labelled.select("prefix_name", "n", "label").distinct()
    entries = posted.select("prefix_name", "n", "token", "place").join(units, ["prefix_name", "n"])
    led = leaders.select("token", F.col("name").alias("lead")).join(labelled.select(F.col("name").alias("lead"), F.col("label").alias("lead_label")), "lead")
    entries = saved(entries.join(led.select("token", "lead_label"), "token").withColumn("stray", F.col("label") != F.col("lead_label")))
    # a long list is dealt over salts: its strays go to each of them
    salts = entries.groupBy("token").agg(F.ceil(F.count("*") / LIST).cast("int").alias("salts"), F.max("stray").alias("any")).filter("any").select("token", "salts")
    entries = entries.join(saved(salts), "token").withColumn("u", F.struct("prefix_name", "n", "label"))
    x = entries.filter("stray").select("token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "u", "n", "place").alias("x")
    y = entries.select("token", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"), "u", "n", "place").alias("y")
    met = x.join(y, ["token", "salt"]).filter((F.col("x.u.label") != F.col("y.u.label")) & _close("x", "y", percent))
    met = met.select(F.least("x.u", "y.u").alias("u"), F.greatest("x.u", "y.u").alias("v")).distinct()
    own = labelled.select(F.struct("prefix_name", "n", "label").alias("unit"), "name")
    pairs = met.join(own.select(F.col("unit").alias("u"), F.col("name").alias("u_name")), "u").join(own.select(F.col("unit").alias("v"), F.col("name").alias("v_name")), "v")
    pairs = pairs.select(F.least("u_name", "v_name").alias("a"), F.greatest("u_name", "v_name").alias("b"))
    more = saved(_verified(pairs, sets, percent))
    return components(links.union(more)) if more.limit(1).count() else label


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, text_hash, n_shingles, component_id (the least id reachable by links), component (its name).

    Two documents link when 100 * intersection >= percent * union of their sets of distinct
    shingles of so many words; a text with fewer words is one shingle. Null texts and those
    without words have no shingles and no links. Repeated rows are linked to each other. A null
    id counts as no id: it links, but is never the least unless alone. Empty tables give empty
    results. Sets are compared as 64-bit hashes of their shingles. Ids are whole numbers; texts are
    taken whole, whatever their length; further columns are left out.
    """
    sets = saved(_sets(docs, id_col, text_col, words, percent))
    able = sets.filter(F.col("members").isNotNull())
    classes = saved(able.groupBy("name").agg(*[F.first(c).alias(c) for c in ("n", "weight", "prefix_name", "prefix", "members")]))
    labels = _class_links(classes, percent)
    rows = sets.select("id", "text_hash", "n", "name").join(labels, F.col("name") == F.col("node"), "left")
    rows = saved(rows.select("id", "text_hash", "n", F.coalesce("label", "name").alias("label")))
    least = rows.filter("n > 0").groupBy("label").agg(F.min("id").alias("component_id"))
    out = rows.join(least, "label", "left")
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.col("label").alias("component"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but for near duplicates: of each component the row of the least id stays, with all its columns.

    Rows without words are linked with nothing and stay. Of repeated rows one stays.
    """
    found = near_duplicates(docs, words, percent, id_col, text_col).withColumnRenamed(id_col, "id").filter("n_shingles > 0")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("k"))
    best = best.select(F.col("k.id").alias("k_id"), F.col("k.text_hash").alias("k_hash"))
    # rows travel in one column, so no name of theirs meets a helper's
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.coalesce(F.col(text_col), F.lit("")).rlike(WORD).alias("wordy"))
    stay = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash"))
    wordy = d.filter("wordy").join(best, stay, "left_semi").dropDuplicates(["id", "hash"])
    return wordy.unionByName(d.filter("NOT wordy")).select("row.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85).drop("text_hash", "component")


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM pair JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y
)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(reach.y) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id
"""
