"""Mixing sources to target weights by Pareto order sampling.

A source gets its weight of the total size. Its documents are expected to stand
in the mix ``e`` times each; the whole part of ``e`` is certain, the rest is drawn:
documents are ranked by the odds of a random number over the odds of their
inclusion, and the first ones are taken until the tokens of the source are
reached. With ``share_reposts`` reposted texts share their chance, so a text is not
preferred for being posted often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kinetrail.llm.bpe import count_column
from kinetrail.session import materialize

#: Bins of the rank in which the last document of a source is looked for.
BINS = 4096
#: Levels of importance: a text that stands 2**k times or more has 2**-k.
LEVELS = 40


def source_key(c: Column) -> Column:
    """A source is the same whatever its letter case, separators and padding; NULL for an empty one."""
    x = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return F.when(x != "", x)


def sized_documents(documents: DataFrame, targets: DataFrame, share_reposts: bool = False) -> DataFrame:
    """Documents of the sources in ``targets``: ``doc_id``, ``source`` as there, ``n_tokens`` and ``level``.

    ``level`` is 0, or with ``share_reposts`` the binary logarithm of how often the text stands there.
    """
    wanted = targets.select(source_key(F.col("source")).alias("k"), F.col("source").alias("__source")).where(F.col("k").isNotNull())
    docs = documents.select("doc_id", "text", source_key(F.col("source")).alias("k")).join(F.broadcast(wanted), "k")  # a row a source
    docs = docs.select("doc_id", F.col("__source").alias("source"), "text", F.xxhash64("text").alias("h"))
    if not share_reposts:
        return count_column(docs, "text", ["doc_id", "source"]).select("doc_id", "source", "n_tokens", F.lit(0).alias("level"))
    sized = materialize(count_column(docs, "text", ["doc_id", "source", "h"]))
    copies = sized.groupBy("source", "h").agg(F.count(F.lit(1)).alias("c"))
    level = F.least(F.floor(F.log2("c")), F.lit(LEVELS - 1)).cast("int")
    return sized.join(copies, ["source", "h"]).select("doc_id", "source", "n_tokens", level.alias("level"))


def expected_copies(tokens: dict[int, float], target: float, most: float) -> dict[int, float]:
    """Copies of a document by level: ``min(most, c * 2**-level)`` with the ``c`` that fills ``target``, all ``most`` where nothing can."""
    if sum(tokens.values()) * most <= target:
        return dict.fromkeys(tokens, most)
    full, rest, left = {}, dict(tokens), target
    while rest:
        mass = sum(t * 2.0**-k for k, t in rest.items())
        c = left / mass if mass else 0.0
        over = [k for k in rest if c * 2.0**-k > most]
        if not over:
            return full | {k: c * 2.0**-k for k in rest}
        for k in over:
            full[k] = most
            left -= most * rest.pop(k)
    return full


class Mix:
    """The mix of one corpus: what each source has, gets, and which documents stand in it.

    ``total`` is the size that the weights are shares of, the tokens of all documents by
    default; up to ``largest_total`` every source with tokens reaches its weight.

    The sources in ``targets`` are a small given list; sizes by source and level go to
    the driver. Documents without tokens and of other sources are not drawn, and
    neither are those of a source with a NULL, zero or negative weight or cap.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, seed: int = 0, total: float | None = None, share_reposts: bool = False):
        self.spark, self.seed = documents.sparkSession, seed
        self.docs = materialize(sized_documents(documents, targets, share_reposts))
        self.targets = {r["source"]: (r["weight"] or 0.0, r["max_repeats"] or 0) for r in targets.select("source", "weight", "max_repeats").collect() if r["source"]}
        self.tokens: dict[str, dict[int, float]] = {s: {} for s in self.targets}
        for r in self.docs.groupBy("source", "level").agg(F.sum("n_tokens").alias("n")).collect():
            self.tokens[r["source"]][r["level"]] = float(r["n"])
        self.total = sum(sum(x.values()) for x in self.tokens.values()) if total is None else total
        #: The largest total size at which every source that has any tokens reaches its weight.
        self.largest_total = min((sum(self.tokens[s].values()) * max(m, 0) / w for s, (w, m) in self.targets.items() if w > 0 and self.tokens[s]), default=0.0)
        self.expected = {s: expected_copies(self.tokens[s], max(w, 0.0) * self.total, float(max(m, 0))) for s, (w, m) in self.targets.items()}

    def short(self) -> DataFrame:
        """Each source that cannot reach its weight: in the mix all of its tokens stand ``max_repeats`` times, and are fewer than its weight asks."""
        full = F.col("mix_tokens") >= F.col("tokens") * F.greatest("max_repeats", F.lit(0))
        return self.shares().where(full & (F.col("mix_tokens") < F.col("target_tokens"))).select("source")

    def copies(self) -> DataFrame:
        """``doc_id``, ``source``, ``n_tokens`` and ``copies``, how often the document stands in the mix, once or more."""
        plan = [(s, k, int(e), e - int(e)) for s, x in self.expected.items() for k, e in x.items()]
        schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("whole", T.IntegerType()), T.StructField("p", T.DoubleType())])
        # at most LEVELS rows for each source of the list
        docs = self.docs.where(F.col("n_tokens") > 0).join(F.broadcast(self.spark.createDataFrame(plan, schema)), ["source", "level"])
        rest = [(s, float(sum((e - int(e)) * self.tokens[s][k] for k, e in x.items()))) for s, x in self.expected.items()]
        # uniform in (0, 1), from the document alone
        u = (F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        odds = (u / (1 - u)) * ((1 - F.col("p")) / F.col("p"))
        ranked = docs.withColumn("q", F.when(F.col("p") > 1e-12, odds / (1 + odds)))
        ranked = ranked.withColumn(
            "bin", F.when(F.col("q").isNotNull(), F.least(F.floor(F.col("q") * BINS), F.lit(BINS - 1))).cast("int")
        )
        # the bin in which the tokens of a source are reached: BINS numbers a source
        filled = ranked.where(F.col("bin").isNotNull()).groupBy("source", "bin").agg(F.sum("n_tokens").alias("n"))
        upto = F.sum("n").over(W.partitionBy("source").orderBy("bin"))
        need = F.broadcast(self.spark.createDataFrame(rest, "source string, need double"))
        last = filled.withColumn("upto", upto).join(need, "source").withColumn("before", F.col("upto") - F.col("n"))
        last = last.where((F.col("before") < F.col("need")) & (F.col("upto") >= F.col("need"))).select("source", F.col("bin").alias("last"), "before", "need")
        ranked = materialize(ranked.join(F.broadcast(last), "source", "left"))  # one row a source
        # within that bin documents are taken one by one; the last goes in if it brings the size nearer
        edge = ranked.where(F.col("bin") == F.col("last"))
        so_far = F.sum("n_tokens").over(W.partitionBy("source").orderBy("q", "doc_id").rowsBetween(W.unboundedPreceding, -1))
        edge = edge.withColumn("at", F.col("before") + F.coalesce(so_far, F.lit(0)))
        edge = edge.withColumn("drawn", F.when(F.col("at") + F.col("n_tokens") / 2 <= F.col("need"), 1).otherwise(0))
        # a source without a last bin gets all of what may be drawn, as its rest rounds to all of it
        other = ranked.where(F.col("bin").isNull() | F.col("last").isNull() | (F.col("bin") != F.col("last")))
        drawn = F.when(F.col("bin").isNull(), 0).when(F.col("last").isNull() | (F.col("bin") < F.col("last")), 1).otherwise(0)
        keep = ["doc_id", "source", "n_tokens"]
        chosen = edge.select(*keep, (F.col("whole") + F.col("drawn")).alias("copies")).unionByName(
            other.select(*keep, (F.col("whole") + drawn).alias("copies"))
        )
        return chosen.where(F.col("copies") > 0)

    def shares(self) -> DataFrame:
        """For each source what it has, its target, and the tokens and the share it reaches."""
        got = self.copies().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count(F.lit(1)).alias("n_docs"))
        rows = [(s, float(w), int(m), int(sum(self.tokens[s].values())), w * self.total) for s, (w, m) in self.targets.items()]
        wanted = self.spark.createDataFrame(rows, "source string, weight double, max_repeats int, tokens bigint, target_tokens double")
        out = wanted.join(got, "source", "left").na.fill(0, ["mix_tokens", "n_docs"])
        whole = F.sum("mix_tokens").over(W.partitionBy())  # a row a source
        return out.withColumn("share", F.col("mix_tokens") / whole).withColumn("largest_total", F.lit(float(self.largest_total)))
