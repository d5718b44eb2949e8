"""An index that takes additions and deletions without being built again.

A **segment** holds the tokenised documents of one addition and their document
frequencies, and is never changed.  A **deletion** holds the deleted keys with the
number of the segment each was found in, and the frequencies they take away.  What
is in force is listed by a version file (``sources.versions``), which also carries
the counts, so opening an index reads no data:

* documents are those of all segments without the deleted ones;
* frequencies are summed over segments, less those of deletions;
* counts of documents, tokens and postings add up likewise.

``compact`` rewrites small segments as one, without what was deleted from them; the
terms are taken over as they are stored.  ``open_index`` gives the ``Index`` of
``operators.retrieval``, with the rows a fresh build of the same documents has.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake import rules
from triagelake.operators.retrieval import (
    Index, corpus_size, document_frequencies, inverse_frequencies, tokenised,
)
from triagelake.sources import versions

SIZES = ("n_docs", "n_tokens", "n_postings", "vector_bytes")
_DOCS = "doc_id bigint, dl bigint, terms array<string>, tfs array<int>, embedding array<float>"
_TERMS = "term string, df bigint"


class SegmentIndex:
    """The segments and deletions under ``path``; every change is a version of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # --- what is in force ---

    def state(self) -> tuple[int, dict]:
        version, content = versions.latest(self.spark, self.path)
        return version, content or {"segments": [], "deletions": []}

    def _publish(self, version: int, segments: list[dict], deletions: list[dict]) -> None:
        versions.publish(
            self.spark, self.path, version + 1, {"segments": segments, "deletions": deletions}
        )

    def _stored(self, name: str, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/{kind}")

    def _union(self, frames: list[DataFrame], schema: str) -> DataFrame:
        if not frames:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, frames)

    def _documents(self, segments: list[dict], deletions: list[dict]) -> DataFrame:
        """Documents in force, with the number of their segment as ``seq``."""
        rows = self._union(
            [self._stored(s["name"], "docs").withColumn("seq", F.lit(s["seq"])) for s in segments],
            f"{_DOCS}, seq int",
        )
        if not deletions:
            return rows
        gone = self._union([self._stored(d["name"], "keys") for d in deletions], "seq int, doc_id bigint")
        return rows.join(gone, ["seq", "doc_id"], "left_anti")

    def documents(self) -> DataFrame:
        _, state = self.state()
        return self._documents(state["segments"], state["deletions"])

    # --- changes ---

    def _write(self, tokenised_docs: DataFrame, seq: int) -> dict:
        name = f"segment-{seq:010d}-{uuid.uuid4().hex[:8]}"
        tokenised_docs.write.parquet(f"{self.path}/{name}/docs")
        stored = self._stored(name, "docs")
        document_frequencies(stored).write.parquet(f"{self.path}/{name}/terms")
        size = corpus_size(stored).first()
        return {"name": name, "seq": seq, **{c: size[c] for c in SIZES}}

    def append(self, docs: DataFrame) -> None:
        """Add documents (as made by ``searchable``); only these are tokenised and counted.

        Their keys must be new, or deleted before; nothing counts otherwise.
        """
        version, state = self.state()
        segment = self._write(tokenised(docs), version + 1)
        added = self._stored(segment["name"], "docs").select("doc_id")
        held = self._documents(state["segments"], state["deletions"]).select("doc_id")
        repeated = (
            added.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id")
            .unionByName(held.join(added, "doc_id", "left_semi")).take(1)
        )
        if repeated:
            raise ValueError(f"the corpus key must be unique and not null: {repeated[0]['doc_id']}")
        self._publish(version, [*state["segments"], segment], state["deletions"])

    def delete(self, keys: DataFrame) -> None:
        """Take the documents of these ``doc_id`` out; keys that are not there are ignored."""
        version, state = self.state()
        name = f"deletion-{version + 1:010d}-{uuid.uuid4().hex[:8]}"
        gone = self._documents(state["segments"], state["deletions"]).join(
            keys.select(F.col("doc_id").cast("bigint")), "doc_id", "left_semi"
        )
        gone.select("seq", "doc_id").write.parquet(f"{self.path}/{name}/keys")
        # the keys as written decide, whatever the key table gives when read again
        taken = self._documents(state["segments"], state["deletions"]).join(
            self._stored(name, "keys"), ["seq", "doc_id"], "left_semi"
        )
        taken.select("seq", F.explode("terms").alias("term")).groupBy("seq", "term").agg(
            F.count(F.lit(1)).alias("df")
        ).write.parquet(f"{self.path}/{name}/terms")
        sizes = {str(s["seq"]): dict.fromkeys(SIZES, 0) for s in state["segments"]}
        for seq in [r["seq"] for r in self._stored(name, "keys").select("seq").distinct().collect()]:
            one = corpus_size(taken.filter(F.col("seq") == seq)).first()
            sizes[str(seq)] = {c: one[c] for c in SIZES}
        self._publish(version, state["segments"], [*state["deletions"], {"name": name, "sizes": sizes}])

    def compact(self, most_docs: int | None = None) -> None:
        """Rewrite the segments of at most ``most_docs`` documents (all by default) as one."""
        version, state = self.state()
        small = [s for s in state["segments"] if most_docs is None or s["n_docs"] <= most_docs]
        kept = [s for s in state["segments"] if s not in small]
        if not small:
            return
        rows = self._documents(small, state["deletions"]).drop("seq")
        merged = self._write(rows, version + 1)
        left = {str(s["seq"]) for s in kept}
        deletions = [
            {**d, "sizes": {q: x for q, x in d["sizes"].items() if q in left}} for d in state["deletions"]
        ]
        # a deletion that touches no segment left is done with
        deletions = [d for d in deletions if any(x["n_docs"] for x in d["sizes"].values())]
        self._publish(version, [*kept, merged], deletions)

    # --- reading ---

    def open_index(self, epsilon: float = rules.BM25_EPSILON) -> Index:
        """The index of the documents in force."""
        _, state = self.state()
        segments, deletions = state["segments"], state["deletions"]
        live = [s["seq"] for s in segments]
        counted = [self._stored(s["name"], "terms").select("term", "df") for s in segments]
        counted += [
            self._stored(d["name"], "terms").filter(F.col("seq").isin(live))
            .select("term", (-F.col("df")).alias("df"))
            for d in deletions
        ]
        frequencies = (
            self._union(counted, _TERMS).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        )
        total = {
            c: sum(s[c] for s in segments) - sum(x[c] for d in deletions for x in d["sizes"].values())
            for c in SIZES
        }
        terms = inverse_frequencies(frequencies, total["n_docs"], epsilon)
        docs = self._documents(segments, deletions).drop("seq")
        return Index(docs, terms, *(total[c] for c in SIZES))
