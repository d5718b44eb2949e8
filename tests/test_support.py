"""Array files, runs, threads, agreement of many raters, retries, live figures, the borderline queue."""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from triagelake import schemas
from triagelake.operators.agreement import fleiss_kappa
from triagelake.operators.metrics import routing_metrics
from triagelake.operators.threads import reply_roots, thread_context
from triagelake.sources import readers
from triagelake.sources.json_arrays import json_objects
from triagelake.sources.runs import RunTable
from triagelake.streaming import arrivals, borderline

# --- JSON arrays ---

ODD = ['{', '}', '"}', '\\', '\\"', '[{"a": "}"}]', "}}{{", "é中\n\t", "", ",", "x" * 300]


def objects(count, seed):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.random()
        if depth < 3 and kind < 0.25:
            return {rng.choice(ODD): value(depth + 1) for _ in range(rng.randint(0, 3))}
        if depth < 3 and kind < 0.4:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([*ODD, 1, None, True, 2.5])

    return [{"id": k, "a": value(0), "b": value(1)} for k in range(count)]


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_are_read_by_many_tasks(spark, tmp_path, split, indent):
    rows = objects(60, split)
    rows[30]["b"] = "}{" * 400  # longer than many splits
    (tmp_path / "one.json").write_text(json.dumps(rows[:50], indent=indent, ensure_ascii=False))
    (tmp_path / "two.json").write_text(json.dumps(["{", *rows[50:], 'a "quoted" }'], indent=indent))
    (tmp_path / "none.json").write_text("[]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        read = json_objects(spark, str(tmp_path))
        tasks = read.rdd.getNumPartitions()
        found = sorted((json.loads(r.value) for r in read.collect()), key=lambda r: r["id"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == rows
    assert tasks > 20 or split > 64


def test_array_reader_is_the_whole_file_reader(spark, tmp_path):
    rows = [
        {"tweet_id": f"t{k}", "query_text": rng, "resolution_text": "r}", "intent": "SOFTWARE_OS_BUG",
         "created_at": "2023-10-12T14:22:00Z"} for k, rng in enumerate(ODD)
    ]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    split = readers.load_resolutions(spark, str(tmp_path / "array.json"), array=True)
    whole = spark.read.schema(schemas.RESOLUTION).option("multiLine", True).json(str(tmp_path / "array.json"))
    assert split.schema == whole.schema
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))


# --- runs ---


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_a_run_counts_once_and_whole(spark, tmp_path, format):
    table = RunTable(spark, f"file://{tmp_path}/t", format)
    with pytest.raises(ValueError):
        table.read()
    rows = spark.range(100).select("id", F.lit("a").alias("x"))
    staged = table.stage(rows, "monday")  # dies here
    assert table.runs() == {}
    table.write(rows, "monday")
    table.write(rows.limit(0), "empty")
    table.write(rows.filter("id < 7").withColumn("x", F.lit("b")), "tuesday")
    table.write(rows, "monday")  # tried again
    assert table.read().groupBy("x").count().orderBy("x").collect() == [("a", 100), ("b", 7)]
    assert table.read(["tuesday"]).count() == 7
    # a task that fails leaves nothing in force
    broken = rows.withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise("c"))
    with pytest.raises(Exception, match="lost"):
        table.write(broken.repartition(5), "monday")
    assert table.read(["monday"]).filter("x = 'a'").count() == 100
    # a writer that committed meanwhile is not lost
    other = RunTable(spark, f"file://{tmp_path}/t", format)
    mine = other.stage(rows.limit(1), "late")
    table.write(rows.limit(2), "early")
    other.commit("late", mine)
    assert set(table.runs()) == {"monday", "tuesday", "empty", "late", "early"}
    assert table.clean() >= 2 and table.read().count() == 110 and table.clean() == 0
    assert staged["folder"] not in {r["folder"] for r in table.runs().values()}


# --- threads ---


def test_roots_depths_and_circles(spark):
    rng = random.Random(3)
    parent = {0: None, 1: 0}
    for k in range(2, 300):  # a long chain and random trees
        parent[k] = k - 1 if k < 130 else rng.choice([None, 99_999, rng.randrange(k)])
    parent |= {400: 402, 401: 400, 402: 401, 403: 402, 404: 404, 405: 404}
    rows = [(k, p, f"m{k}") for k, p in parent.items()] + [(None, 5, "lost"), (None, None, "lost")]
    messages = spark.createDataFrame(rows, "id bigint, parent_id bigint, text string").repartition(4)
    got = {r.id: r for r in reply_roots(messages).collect() if r.id is not None}
    for k in parent:
        path, at = [k], k
        while parent[at] is not None and parent[at] in parent and parent[at] not in path:
            at = parent[at]
            path.append(at)
        circle = parent[at] in path
        r = got[k]
        assert r.circular == circle and r.orphan == (parent[k] is not None and parent[k] not in parent)
        assert (r.root, r.depth) == ((None, None) if circle else (at, len(path) - 1))
    context = {r.id: r.context for r in thread_context(messages, 2, separator="|").collect()}
    assert context[50] == "m48|m49" and context[1] == "m0" and context[0] == ""
    none = spark.createDataFrame([], messages.schema)
    assert reply_roots(none).count() == thread_context(none, 2).count() == 0


# --- many raters ---


def plain(items):
    """(kappa, agreement, chance) of lists of ratings."""
    items = [Counter(x) for x in items if len(x) > 1]
    if not items:
        return None, None, None
    agree = [sum(n * (n - 1) for n in c.values()) / (sum(c.values()) * (sum(c.values()) - 1)) for c in items]
    whole = sum(items, Counter())
    chance = sum((n / sum(whole.values())) ** 2 for n in whole.values())
    mean = sum(agree) / len(agree)
    return (None if chance >= 1 else (mean - chance) / (1 - chance)), mean, chance


def test_fleiss_kappa_and_its_error(spark):
    rng = random.Random(8)
    groups = {
        "a": [[rng.choice("xyz") if rng.random() < 0.5 else "x" for _ in range(rng.randint(0, 6))] for _ in range(60)],
        "b": [["x", "x"], ["y", "y", "y"]], "c": [["x", "x"], ["x", "x"]], "d": [["x"], ["y"]],
        "e": [["x", "y"]], None: [["x", "y", "x"], ["y", "y"], ["x", "x", "y"]],
    }
    rows = [(g, k, c) for g, items in groups.items() for k, x in enumerate(items) for c in [*x, None]]
    ratings = spark.createDataFrame(rows, "g string, item int, category string").repartition(5)
    got = {r.g: r for r in fleiss_kappa(ratings, by=["g"]).collect()}
    for g, items in groups.items():
        kept = [x for x in items if len(x) > 1]
        kappa, agreement, chance = plain(kept)
        if agreement is None:
            assert g not in got
            continue
        r = got[g]
        assert (r.items, r.ratings) == (len(kept), sum(map(len, kept)))
        assert r.agreement == pytest.approx(agreement) and r.chance == pytest.approx(chance)
        assert (r.kappa is None) == (kappa is None) and (kappa is None or r.kappa == pytest.approx(kappa))
        without = [plain(kept[:k] + kept[k + 1 :])[0] for k in range(len(kept))]
        if len(kept) < 2 or None in without:
            assert r.stderr is None
        else:
            n, mean = len(kept), sum(without) / len(kept)
            assert r.stderr == pytest.approx(math.sqrt((n - 1) / n * sum((x - mean) ** 2 for x in without)), abs=1e-12)
    one = fleiss_kappa(ratings.filter("g = 'a'")).first()
    assert one.kappa == pytest.approx(plain(groups["a"])[0])
    assert fleiss_kappa(ratings.filter("g = 'none'"), by=["g"]).count() == 0


# --- streams with state ---


class Feed:
    """A folder of files read as a stream; ``send`` adds one and runs to the end."""

    def __init__(self, spark, folder, schema, plan):
        self.spark, self.folder, self.schema, self.plan, self.sent = spark, folder, schema, plan, 0

    def send(self, rows):
        self.sent += 1
        frame = self.spark.createDataFrame(rows, self.schema)
        frame.coalesce(1).write.parquet(f"{self.folder}/in/part={self.sent}")
        stream = self.spark.readStream.schema(frame.schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/in")
        query = (
            self.plan(stream).writeStream.format("parquet").option("path", f"{self.folder}/out")
            .option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return query

    def out(self):
        return self.spark.read.parquet(f"{self.folder}/out")


def at(minute):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_retries_across_restarts(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), "id string, text string, at timestamp",
                lambda s: arrivals.first_arrivals(s, "at", "10 minutes"))
    feed.send([("a", "x", at(0)), (None, "same", at(0)), (None, "same", at(1))])
    feed.send([("a", "x again", at(2)), (None, "same", at(3)), ("b", "y", at(5))])
    feed.send([("c", "z", at(60))])
    query = feed.send([("a", "x", at(61)), ("b", "late", at(5)), (None, None, at(61)), (None, "", at(62))])
    got = sorted((r.text or "", r.at.minute) for r in feed.out().collect())
    # after an hour the first ones are forgotten; a row far behind the watermark is dropped
    assert got == [("", 1), ("same", 0), ("x", 0), ("x", 1), ("y", 5), ("z", 0)]
    assert arrivals.late_rows(query) == 1
    states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert states[-1] <= 3  # a and the empty text of the last file, and perhaps c


def test_final_windows_are_the_batch_metrics(spark, tmp_path):
    rng = random.Random(4)
    actions = ["AUTO_HANDLE", "ESCALATE"]
    rows = [(at(rng.randrange(600)), rng.choice(actions), rng.choice(actions), rng.random() < 0.3) for _ in range(400)]
    rows.sort(key=lambda r: r[0])
    schema = "at timestamp, expected_action string, action string, is_critical boolean"
    feed = Feed(spark, str(tmp_path), schema, lambda s: arrivals.routing_windows(s, "at", "1 hour", "30 minutes"))
    for start in range(0, 400, 100):
        feed.send(rows[start : start + 100])
    feed.send([(at(5000), "", "", False)])
    late = feed.send([(at(3), *rows[0][1:]), (at(70), *rows[1][1:])])
    assert arrivals.late_rows(late) == 2
    batch = spark.createDataFrame(rows, schema).withColumn("start", F.date_trunc("hour", "at"))
    want = {tuple(r) for r in routing_metrics(batch, by=["start"]).collect()}
    got = {tuple(r) for r in feed.out().drop("end").collect()}
    assert got == want


def test_borderline_queue(spark, tmp_path):
    schema = "id string, at timestamp, confidence double, verdict string"
    feed = Feed(spark, str(tmp_path), schema, lambda s: borderline.decide(s, 30 * 60_000))
    feed.send([("auto", at(0), 0.9, None), ("low", at(0), 0.7, None), ("waits", at(0), 0.8, None),
               ("late", at(1), 0.8, None), ("early", at(1), None, "ESCALATE"), ("edge", at(2), 0.85, None)])
    assert {(r.id, r.outcome) for r in feed.out().collect()} == {("auto", "auto"), ("low", "escalated"), ("edge", "auto")}
    feed.send([("waits", at(10), None, "AUTO_HANDLE"), ("early", at(12), 0.8, None), ("other", at(20), 0.99, None)])
    feed.send([("other", at(100), 0.99, None)])
    feed.send([("late", at(101), None, "AUTO_HANDLE"), ("x", at(300), 0.99, None)])
    got = {(r.id, r.outcome, (r.decided_at - at(0)).total_seconds() / 60) for r in feed.out().collect()}
    assert {g for g in got if g[0] in ("waits", "early", "late")} == {
        ("waits", "released", 10), ("early", "rejected", 12), ("late", "timed_out", 31)}
    assert Counter(g[0] for g in got)["late"] == 1


def test_kappa_goes_on_from_counts_written_once(spark):
    """The ratings are read and counted once, not by each of the sums over them."""
    ratings = spark.range(60).select((F.col("id") % 20).alias("item"), (F.col("id") % 7).alias("category"))
    found = fleiss_kappa(ratings)
    assert "Range (" in ratings._jdf.queryExecution().executedPlan().toString()
    assert "Range (" not in found._jdf.queryExecution().executedPlan().toString()


def test_borderline_ids_share_their_state(spark, tmp_path):
    """Many ids in one bucket are decided each by itself, by one call of Python a batch."""
    schema = "id string, at timestamp, confidence double, verdict string"
    feed = Feed(spark, str(tmp_path), schema, lambda s: borderline.decide(s, 30 * 60_000, buckets=1))
    feed.send([(f"m{k}", at(k % 5), 0.8, None) for k in range(100)] + [("bad", at(0), None, None)])
    feed.send([(f"m{k}", at(5 + k % 40), None, "AUTO_HANDLE") for k in range(0, 100, 2)])
    feed.send([("end", at(500), 0.9, None)])
    got = {(r.id, r.outcome, (r.decided_at - at(0)).total_seconds() / 60) for r in feed.out().collect()}
    assert {g for g in got if g[0][0] == "m"} == {
        (f"m{k}", "released", 5 + k % 40) if k % 2 == 0 and 5 + k % 40 <= k % 5 + 30
        else (f"m{k}", "timed_out", k % 5 + 30)
        for k in range(100)
    }
    assert ("bad", "escalated", 0) in got
