"""Arrow shards, JSON documents and lines by byte range."""

import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from speechloom.operators import dataset, review
from speechloom.sources import arrow_shards, files, json_ranges
from speechloom.sources.arrow_shards import read_shards, write_shards

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(3).cache()


@pytest.fixture(scope="module")
def saved(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shards"))
    write_shards(docs, path, 100_000)
    return path


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("range_bytes", [7777, 1 << 27])
def test_ranges_give_every_row_once(spark, docs, saved, range_bytes):
    assert same(read_shards(spark, saved, range_bytes=range_bytes), docs)


def test_shards_are_of_bounded_size(saved):
    sizes = [n for _, n in arrow_shards.shards(saved)]
    assert len(sizes) > 3 and max(sizes) < 130_000


def test_columns_and_conditions_reach_the_scan(spark, docs, saved, capsys):
    some = read_shards(spark, saved, ["doc_id", "lang"], [("source", "in", ["src1", "src2"]), ("n_chars", ">", 500)])
    assert same(some, docs.where("source IN ('src1', 'src2') AND n_chars > 500").select("doc_id", "lang"))
    assert some.schema.names == ["doc_id", "lang"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = read_shards(spark, saved, ["doc_id", "lang"]).where("lang = 'en' AND doc_id > 20 AND doc_id % 2 = 0")
        pushed.explain("formatted")
        plan = capsys.readouterr().out
        assert "EqualTo(lang,en)" in plan and "GreaterThan(doc_id,20)" in plan
        assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
        assert same(pushed, docs.where("lang = 'en' AND doc_id > 20 AND doc_id % 2 = 0").select("doc_id", "lang"))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(ValueError, match="absent"):
        read_shards(spark, saved, ["absent"])


def test_samples_stop_early(spark, docs, saved):
    whole = [r.doc_id for r in read_shards(spark, saved).collect()]
    for n in (1, 7, 60, 10_000):
        some = [r.doc_id for r in read_shards(spark, saved, max_samples=n).collect()]
        assert some == whole[:n]
    reader = arrow_shards.ShardReader(saved, docs.schema, [], 1 << 27, 7)
    assert len({p.path for p in reader.partitions()}) == 1


def test_files_of_other_writers_splits_and_nulls(spark, tmp_path):
    table = pa.table({"a": pa.array([1, None, 3], pa.int64()), "t": pa.array(["x", None, "z"]), "d": pa.array(["p", "q", "p"]).dictionary_encode()})
    for split, kind in (("test", pa.ipc.new_file), ("validation", pa.ipc.new_stream)):
        (tmp_path / split).mkdir()
        with kind(str(tmp_path / split / "data-00000-of-00001.arrow"), table.schema) as out:
            out.write_table(table, max_chunksize=2)
    want = sorted([(1, "x", "p"), (3, "z", "p"), (None, None, "q")], key=repr)
    for split in ("test", "validation"):
        for size in (64, 1 << 20):
            rows = read_shards(spark, str(tmp_path), split=split, range_bytes=size).collect()
            assert sorted(map(tuple, rows), key=repr) == want
    # There is no split of that name: the first one is taken.
    assert read_shards(spark, str(tmp_path), split="train").count() == 3
    assert [r.a for r in read_shards(spark, str(tmp_path), ["a"], [("t", "not null", None)]).collect()] == [1, 3]
    assert [r.a for r in read_shards(spark, str(tmp_path), ["a"], [("a", "null", None)]).collect()] == [None]


def test_appended_and_empty_shards(spark, docs, tmp_path):
    path = str(tmp_path / "x")
    write_shards(docs.limit(5), path)
    write_shards(docs.limit(5), path, mode="append")
    assert read_shards(spark, path).count() == 10
    write_shards(docs.limit(3), path)
    assert read_shards(spark, path).count() == 3


TRICKY = [
    {"id": "a", "text": 'brackets ] } [ { and "quotes" \\ back\\\\slashes \\"', "diarization": [{"start": 0.0, "end": 1.5, "text": "}", "speaker": "]"}] * 4},
    {"id": "ß😀", "t": "line\nbreak", "x": {"y": [[], {}, [1, [2, {"z": "},{"}]]]}},
    {"text": "\\"},
    {},
    {"id": None, "n": [1, 2, 3], "long": "[{" * 200},
    {"id": "e", "text": '"}]'},
]


@pytest.fixture
def range_size(spark):
    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if n > 1 << 20 else "1")

    yield put
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [29, 301, 1 << 27])
def test_records_of_lists_for_every_range(spark, tmp_path, range_size, size):
    rng = random.Random(size)
    files = {f"{i}.json": [rng.choice(TRICKY) for _ in range(n)] for i, n in enumerate((7, 1, 0, 12))}
    for i, (name, rows) in enumerate(files.items()):
        (tmp_path / name).write_text("﻿" * (i == 1) + " \n" * i + json.dumps(rows, ensure_ascii=False, indent=i or None) + "\n" * (i % 2), encoding="utf-8")
    range_size(size)
    got = json_ranges.json_records(spark, str(tmp_path)).collect()
    for name, rows in files.items():
        own = sorted((r.ordinal, r.record) for r in got if r.file.endswith("/" + name))
        assert [n for n, _ in own] == list(range(len(rows)))
        assert [json.loads(t) for _, t in own] == rows
    numbers = [r.number for r in got]
    assert len(set(numbers)) == len(numbers)
    assert [(r.file, r.ordinal) for r in sorted(got, key=lambda r: r.number)] == sorted((r.file, r.ordinal) for r in got)


@pytest.mark.parametrize("size", [61, 1 << 27])
def test_records_of_objects_and_their_lists(spark, tmp_path, range_size, size):
    documents = {
        "one": TRICKY[0],
        "member": {"meta": {"n": [1, 2], "s": "["}, "x": "[", "items": TRICKY, "more": [1, 2, 3], "tail": {"a": [0]}},
        "nested": {"a": {"b": [1]}, "items": [[1, "]"], {"k": [2]}, "s,", 4]},
        "no list": {"a": {"b": [1]}, "c": "d"},
        "empty list": {"items": [], "more": [1]},
    }
    for name, d in documents.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=2 if name == "member" else None) + "\n" * (name == "one"))
    (tmp_path / "blank.json").write_text(" \n")
    range_size(size)
    want = {"one": TRICKY[0]["diarization"], "member": TRICKY, "nested": documents["nested"]["items"], "no list": [documents["no list"]], "empty list": []}
    members, whole = json_ranges.json_records(spark, str(tmp_path), members=True).collect(), json_ranges.json_records(spark, str(tmp_path)).collect()
    for name in documents:
        mine = lambda rows: [json.loads(r.record) for r in sorted(rows, key=lambda r: r.ordinal) if r.file.replace("%20", " ").endswith(f"/{name}.json")]  # noqa: B023, E731
        assert mine(members) == want[name]
        assert mine(whole) == [documents[name]]


def test_broken_documents_are_errors(spark, tmp_path):
    for i, text in enumerate(['[{"a": 1}', '[{"a": "1}]', "42", '{"a": [1}']):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        if i < 3:
            with pytest.raises(ValueError, match=f"{i}.json"):
                json_ranges.json_records(spark, str(path))


@pytest.mark.parametrize("size", [23, 1 << 27])
def test_line_numbers_over_splits(spark, tmp_path, range_size, size):
    texts = {"a.txt": ["one", "", "three ß", " ", "five"] * 9, "b.txt": ["x"] * 30, "c.txt": ["last, without an end"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name != "c.txt" else ""))
    range_size(size)
    got = sorted((r.file.rsplit("/", 1)[1], r.number, r.line) for r in json_ranges.numbered_lines(spark, str(tmp_path)).collect())
    assert got == sorted((n, i, x) for n, lines in texts.items() for i, x in enumerate(lines, 1) if x.strip(" "))


def test_strict_lines_name_file_and_number(spark, tmp_path, range_size):
    lines = [json.dumps({"seq": i, "state": "ok"}) for i in range(400)]
    (tmp_path / "good.jsonl").write_text("\n".join(lines))
    range_size(1000)
    rows = json_ranges.strict_rows(spark, str(tmp_path / "good.jsonl"), "seq long, state string")
    assert rows.rdd.getNumPartitions() > 4
    assert sorted((r.number, r.seq) for r in rows.collect()) == [(i + 1, i) for i in range(400)]
    lines[276] = '{"seq": 276, "state'
    (tmp_path / "bad.jsonl").write_text("\n".join(lines))
    with pytest.raises(PySparkException, match=r"bad.jsonl, line 277: not JSON"):
        json_ranges.strict_rows(spark, str(tmp_path / "bad.jsonl"), "seq long, state string").agg(F.sum("seq")).collect()


def test_configurations_are_named(spark, tmp_path):
    for config, n in (("en", 2), ("uz", 3)):
        for split in ("test", "train"):
            write_shards(spark.range(n), str(tmp_path / config / split))
    with pytest.raises(Exception, match="en, uz"):
        read_shards(spark, str(tmp_path))
    assert read_shards(spark, str(tmp_path), config="uz").count() == 3
    assert read_shards(spark, str(tmp_path), config="en", split="absent").count() == 2


def test_shards_of_rows_of_skewed_sizes(spark, tmp_path):
    """Only a row that is larger than the limit passes it, alone in its shard."""
    sizes = [10, 200_000, 50, 90_000, 30, 30, 30, 400_000, 60_000, 60_000, 10] + [1000] * 300
    rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "i long, t string").coalesce(1)
    write_shards(rows, path := str(tmp_path / "x"), 150_000)
    for file, size in arrow_shards.shards(path):
        with pa.ipc.open_stream(file) as f:
            n = f.read_all().num_rows
        assert size < 160_000 or n == 1
    assert same(read_shards(spark, path), rows)


def test_fetches_only_what_is_lacking(spark):
    asked = spark.sparkContext.accumulator(0)

    def provider(batch):
        asked.add(len(batch))
        return ["ok" for _ in batch]

    rows = spark.createDataFrame([("u1", "d/a.wav"), ("u2", "d/b.wav"), ("u2", "d/b.wav"), (None, "d/c.wav"), ("u4", "d/d.wav")], "url string, target string")
    have = spark.createDataFrame([("a.wav",)], "file_name string")
    got = files.fetched(rows, "url", "target", have, provider).collect()
    assert sorted((r.target, r.fetched) for r in got) == [("d/b.wav", "ok"), ("d/d.wav", "ok")] and asked.value == 2
    assert files.fetched(rows, "url", "target", rows.selectExpr("substring(target, 3) AS file_name"), provider).count() == 0


def test_modes_of_a_run(spark):
    rows = spark.createDataFrame([(f"f{i:03}",) for i in range(150)] + [(None,)], "file_name string")
    first = dataset.rows_of_mode(rows.where("file_name IS NOT NULL"), "test")
    assert sorted(r.file_name for r in first.collect()) == [f"f{i:03}" for i in range(100)]
    assert dataset.rows_of_mode(rows, "continue", used=dataset.manifest(first)).count() == 51
    assert dataset.rows_of_mode(rows, "full").count() == 151 and dataset.rows_of_mode(rows, "skip").count() == 0
    for mode, df in (("other", rows), ("continue", rows), ("test", rows.limit(0))):
        with pytest.raises(ValueError):
            dataset.rows_of_mode(df, mode)


def test_actions_of_a_review(spark):
    segments = spark.createDataFrame([("a", "one", None), ("b", None, "two"), ("c", "three", None)], "file_name string, transcription string, original_text string")
    log = [(1, "approve", "a", "one"), (2, "next", None, None), (3, "reject", "b", None), (4, "previous", None, None), (5, "approve", "b", "two!"), (6, "approve", "absent", "x"), (7, "next", None, None), (8, "next", None, None)]
    actions = spark.createDataFrame([(*r, "s") for r in log] + [(1, "previous", None, None, "t")], "seq long, action string, file_name string, text string, session string")
    decisions = review.decided(review.acted(actions, segments))
    got = {r.file_name: (r.decision, r.text) for r in review.merged(segments, decisions).collect()}
    assert got == {"a": ("approved", "one"), "b": ("edited", "two!"), "c": ("pending", "three")}
    assert {r.session: r.place for r in review.places(actions, "session", 3).collect()} == {"s": 2, "t": 0}
    df = spark.createDataFrame([(1, 3, False), (0, 0, True), (0, 0, False), (3, 3, True)], "d int, t int, f boolean")
    assert [r.p for r in df.select(review.percent(F.col("d"), F.col("t"), F.col("f")).alias("p")).collect()] == [33, 100, 0, 100]


def test_batches_of_json_pieces_are_not_held_whole():
    """A batch of 64 MB: few of its rows are Python values at once, and what is made of them is handed on in small parts."""
    batch = pa.RecordBatch.from_pydict({"value": ["x" * 8000] * 8000})
    run = json_ranges._mapped(type("", (), {"mapInArrow": lambda self, run, schema: run})(), "value string", lambda rows: ((v + "}",) for (v,) in rows))
    tracemalloc.start()
    n = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 8000 and peak < 24 << 20
