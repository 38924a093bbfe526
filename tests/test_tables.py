"""Sources, sinks, joins, curation and whole jobs."""

import json
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom import constants as C
from gradeloom.operators import chunks
from gradeloom.operators import curation as Q
from gradeloom.operators import joins as J
from gradeloom.operators import results as O
from gradeloom.operators.batches import build_request
from gradeloom.operators.chunks import chunk_sizes, plan_request_chunks
from gradeloom.plans.benchmark import run_benchmark
from gradeloom.plans.compare import compare_models
from gradeloom.plans.convert import resume_batch, retrieve_batch, submit_batch
from gradeloom.plans.prepare import prepare_training
from gradeloom.session import shared_dir
from gradeloom.sources import responses
from gradeloom.sources.responses import parse_responses, read_batch_responses, response_lines, unreadable_lines
from catalog import queries
from gradeloom.sources.shards import exclude_files, file_offsets, read_shards, shard_name, table_rows, tag_split, with_row_index
from gradeloom.sources.sinks import export_split, write_detail_csv, write_request_chunks, write_results
from gradeloom.sources.splits import read_eval_split, read_ground_truth
from gradeloom.sources.store import ResultStore
from gradeloom.streaming.ingest import ingest_responses, read_ingested


@pytest.fixture
def shards(spark, tmp_path):
    """Three shards, written out of order; ids follow the sorted file names."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    folder = tmp_path / "data"
    folder.mkdir()
    start = 0
    for name, n in (("test-00000-of-00001", 3), ("train-00000-of-00002", 7), ("train-00001-of-00002", 5)):
        ids = list(range(start, start + n))
        pq.write_table(pa.table({
            "sketch_image": [{"bytes": b"img%d" % i, "path": None} for i in ids],
            "tikz_code": [f" code {i} " for i in ids], "tool": ["t"] * n, "uri": ["u"] * n,
        }), folder / f"{name}.parquet", row_group_size=2)
        start += n
    return str(folder)


def test_read_tag_and_index(spark, shards):
    df = with_row_index(tag_split(read_shards(spark, shards, ["tikz_code"])))
    assert df.columns == ["tikz_code", "split", "row_idx"]
    rows = df.orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(15))
    assert [r.tikz_code for r in rows] == [f" code {i} " for i in range(15)]
    assert [r.split for r in rows] == ["test"] * 3 + ["train"] * 12


def test_row_index_does_not_depend_on_partitioning(spark, shards):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        df = with_row_index(read_shards(spark, shards, ["tikz_code"]))
        assert df.rdd.getNumPartitions() > 3
        assert {r.row_idx: r.tikz_code for r in df.collect()} == {i: f" code {i} " for i in range(15)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_exclude_files(spark, shards):
    kept = read_shards(spark, shards, ["tikz_code"], exclude=["train-00000-of-00002.parquet"])
    assert kept.count() == 8
    assert with_row_index(kept).agg(F.max("row_idx")).first()[0] == 7
    with pytest.raises(FileNotFoundError):
        read_shards(spark, shards, exclude=[p.name for p in Path(shards).iterdir()])


def test_eval_split_and_truth_layouts(spark, tmp_path):
    rows = [(b"1", "a"), (b"2", ""), (b"3", None)]
    flat = spark.createDataFrame(rows, "image_bytes binary, uml_code string").coalesce(1)
    chat = Q.format_training_chat(flat)
    frames = {
        "flat": flat,
        "chat": chat,
        "both": chat.withColumn("uml_code", F.when(F.col("image_bytes") == b"1", "direct")),
        "source": flat.select(F.struct(F.col("image_bytes").alias("bytes")).alias("sketch_image"), "uml_code"),
        "blind": flat.select("uml_code"),
    }
    truth = {}
    for name, df in frames.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        out = read_eval_split(spark, f"{tmp_path}/{name}").orderBy("row_idx" if name != "blind" else "uml_code_gt")
        truth[name] = [(bytes(r.image_bytes), r.uml_code_gt) for r in out.collect()]
    plain = [(b"1", "a"), (b"2", ""), (b"3", "")]
    assert truth["flat"] == truth["source"] == truth["chat"] == plain
    assert truth["both"] == [(b"1", "direct"), (b"2", ""), (b"3", "")] and truth["blind"] == []
    assert [r.uml_code_gt for r in read_ground_truth(spark, f"{tmp_path}/chat").orderBy("row_idx").collect()] == [
        "a", "", ""]
    spark.range(1).write.parquet(f"{tmp_path}/neither")
    with pytest.raises(ValueError):
        read_ground_truth(spark, f"{tmp_path}/neither")


def test_attach_ground_truth_needs_equal_counts(spark):
    pred = spark.createDataFrame([(0, "p", "old"), (1, "q", "old")], "row_idx long, uml_pred string, uml_code_gt string")
    truth = spark.createDataFrame([(1, "t1"), (0, "t0")], "row_idx long, uml_code_gt string")
    got = {r.row_idx: r.uml_code_gt for r in J.attach_ground_truth(pred, truth).collect()}
    assert got == {0: "t0", 1: "t1"}
    with pytest.raises(ValueError):
        J.attach_ground_truth(pred, truth.where("row_idx = 0"))


def test_resume(spark):
    todo, done = spark.range(10).toDF("row_idx"), spark.range(0, 10, 2).toDF("row_idx")
    assert {r.row_idx for r in J.resume_increment(todo, done).collect()} == {1, 3, 5, 7, 9}


def test_result_rows(spark):
    df = spark.createDataFrame([(0, None, None), (1, "c", []), (2, "c", ["x", "y"]), (3, "c", None)],
                               "row_idx long, uml_code string, errors array<string>")
    rows = O.result_row(df, failed_message="gone").orderBy("row_idx").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("", False, "gone", True), ("c", True, "", False), ("c", False, "x; y", False), ("c", True, "", False)]
    checked = O.check_predictions(df.select("row_idx", F.col("uml_code").alias("uml_pred")))
    rows = checked.orderBy("row_idx").collect()
    assert (rows[0].uml_pred, rows[0].uml_valid, rows[0].uml_error, rows[0].llm_failed) == ("", False, "LLM failure", True)
    assert (rows[1].uml_error, rows[1].llm_failed) == (C.MISSING_START, False)
    assert [r[0] for r in df.select(O.classify_outcome(F.lit(True), F.col("row_idx") == 1)).collect()].count("valid") == 1


def png(*chunks):
    out = b"\x89PNG\r\n\x1a\n"
    for name, data in (*chunks, (b"IEND", b"")):
        out += struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return out


@pytest.mark.parametrize("code, reason, kind, body, error", [
    (400, "", None, None, C.RENDER_REJECTED),
    (503, "Busy", None, None, "PlantUML server returned HTTP 503: Busy"),
    (None, "timed out", None, None, "HTTP request failed: timed out"),
    (200, "", "text/html", b"<html>", "Server returned unexpected content-type: text/html"),
    (200, "", None, b"", "Server returned unexpected content-type: "),
    (200, "", "image/png", png((b"IDAT", b"\x00\xff\x80ok")), None),
    (200, "", "image/svg+xml", b"<svg/>", None),
    (200, "", "image/png", png((b"IDAT", b"x" * 300), (b"tEXt", b"plantuml\0 a syntax slip ")),
     "PlantUML server reported: a syntax slip"),
    (200, "", "image/png", png((b"tEXt", b"plantuml\0unknown 1"), (b"tEXt", b"plantuml\0fine"), (b"tEXt", b"error\0cannot do")),
     "PlantUML server reported: cannot do"),
    (200, "", "image/png", png((b"tEXt", b"other\0syntax"), (b"tEXt", b"plantuml syntax")), None),
    (200, "", "image/png", png((b"IDAT", b"\xe9" * 30 + b"line 3 Syntax Error?\x01\n" + b"z" * 200)),
     "PlantUML server reported: line 3 Syntax Error?\n" + "z" * 105),
    (200, "", "image/png", b"Unexpected token", "PlantUML server reported: Unexpected token"),
])
def test_classify_render_response(spark, code, reason, kind, body, error):
    df = spark.createDataFrame([(7, code, reason, kind, body)],
                               "row_idx long, http_code int, reason string, content_type string, body binary")
    row = O.classify_render_response(df).first()
    assert (row.row_idx, row.uml_valid, row.errors) == (7, error is None, [error] if error else [])


def next_fit(sizes, cap):
    parts, part, held = [], 0, 0
    for size in sizes:
        if held + size > cap and held:
            part, held = part + 1, 0
        held += size
        parts.append(part)
    return parts


@pytest.mark.parametrize("sizes, cap, block_rows, fan_in", [
    ([4, 4, 4], 8, 100, 2), ([20], 8, 100, 2), ([3, 20, 3, 5], 8, 2, 2),
    ([(i * 37) % 23 + 1 for i in range(200)], 50, 5, 3), ([1] * 100, 1000, 4, 2),
    ([(i * 7) % 5 + 1 for i in range(300)], 6, 300, 2),
])
def test_chunks_equal_one_sequential_pass(spark, sizes, cap, block_rows, fan_in):
    lines = spark.createDataFrame([(i, "x" * (n - 1)) for i, n in enumerate(sizes)], "row_idx long, line string")
    plan = plan_request_chunks(lines.repartition(5), cap, block_rows, fan_in).orderBy("row_idx").collect()
    assert [r.bytes for r in plan] == sizes
    assert [r.part for r in plan] == next_fit(sizes, cap)


def test_starts_are_found_by_doubling():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes, cap = rng.integers(1, 30, rng.integers(1, 80)), int(rng.integers(1, 90))
        for carry in (0, int(rng.integers(1, cap + 1))):
            parts, part, held = [], 0, carry
            for i, size in enumerate(sizes.tolist()):
                if held + size > cap and held or not held and not i:
                    parts.append(i)
                    held = 0
                held += size
            assert chunks.starts(sizes, carry, cap).tolist() == parts
        left, closed = chunks._chain(sizes, cap)
        for first in range(len(sizes)):
            parts = next_fit(sizes[first:].tolist(), cap)
            open_bytes = sum(x for x, q in zip(sizes[first:].tolist(), parts) if q == parts[-1])
            assert (left[first], closed[first]) == (min(open_bytes, cap), parts[-1])


@pytest.mark.parametrize("entries", [0, 10**6])
def test_request_lines_move_once(spark, tmp_path, monkeypatch, entries):
    """The index is broadcast when short; parts are the same when it is joined by block."""
    monkeypatch.setattr(chunks, "BROADCAST_ENTRIES", entries)
    sizes = [(i * 37) % 23 + 1 for i in range(200)]
    lines = spark.createDataFrame([(i, "x" * (n - 1)) for i, n in enumerate(sizes)], "row_idx long, line string")
    plan = write_request_chunks(lines, str(tmp_path / "out"), cap=50, block_rows=16, fan_in=3)
    assert [r.part for r in plan.orderBy("row_idx").collect()] == next_fit(sizes, 50)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert entries == 0 or ("BroadcastHashJoin" in text and "hashpartitioning" not in text)


def test_chunks_of_nothing(spark):
    assert plan_request_chunks(spark.createDataFrame([], "row_idx long, line string")).count() == 0


def test_write_request_chunks(spark, tmp_path):
    lines = spark.createDataFrame([(i, "é" * (i % 9) + str(i)) for i in range(50)] + [(50, None)],
                                  "row_idx long, line string").repartition(4)
    plan = write_request_chunks(lines, str(tmp_path / "out"), cap=60, block_rows=8)
    folders = sorted((tmp_path / "out").glob("part=*"), key=lambda p: int(p.name[5:]))
    texts = []
    for folder in folders:
        [file] = folder.glob("*.txt")
        assert file.stat().st_size <= 60
        texts += file.read_text().splitlines()
    assert texts == ["é" * (i % 9) + str(i) for i in range(50)]
    sizes = {r.part: r for r in chunk_sizes(plan).collect()}
    assert len(sizes) == len(folders) and sum(r.n_requests for r in sizes.values()) == 50


def test_requests(spark):
    df = spark.createDataFrame([(0, " \\draw \"x\" é\n", b"\x00\x01"), (1, None, None)],
                               "row_idx long, tikz_code string, image binary")
    text = build_request(df, "tikz_code", "text", "m", max_tokens=C.TEXT_MAX_TOKENS).orderBy("row_idx").collect()
    assert json.loads(text[0].line) == {
        "custom_id": "req_0", "method": "POST", "url": C.REQUEST_URL, "body": {
            "model": "m", "temperature": 0.0, "max_tokens": 8192, "messages": [
                {"role": "system", "content": C.TEXT_SYSTEM_PROMPT},
                {"role": "user", "content": C.TEXT_USER_PREFIX + "\\draw \"x\" é"}]}}
    assert text[1].line is None
    image = build_request(df, "image", "image", "m").orderBy("row_idx").first()
    assert json.loads(image.line)["body"]["messages"][1]["content"] == [
        {"type": "text", "text": C.IMAGE_USER_PROMPT},
        {"type": "image_url", "image_url": {"url": "data:image/png;base64,AAE="}}]
    with pytest.raises(ValueError):
        build_request(df, "image", "audio", "m")


def response(i, text, status=200):
    return json.dumps({"custom_id": f"req_{i}", "response": {
        "status_code": status, "body": {"choices": [{"message": {"content": text}}]}}})


def test_responses_last_one_wins(spark, tmp_path):
    (tmp_path / "z.jsonl").write_text("\n".join([response(0, "old"), "", response(1, "x"), response(1, "y")]) + "\n")
    (tmp_path / "a.jsonl").write_text(response(0, "<think>t</think> new ") + "\n" + response(2, "lost", 500) + "\n")
    read = read_batch_responses(spark, [str(tmp_path / "z.jsonl"), str(tmp_path / "a.jsonl")])
    latest = {r.row_idx: r.uml_code for r in J.latest_response(read).collect()}
    assert latest == {0: "new", 1: "y", 2: None}
    source = spark.range(4).toDF("row_idx")
    merged = {r.row_idx: r for r in J.merge_responses(source, J.latest_response(read)).collect()}
    assert [merged[i].llm_failed for i in range(4)] == [False, False, True, True]
    assert merged[3].uml_error == C.FAILED_IN_BATCH
    assert not merged[0].uml_valid and merged[0].uml_error == C.PREFLIGHT_MISSING_START
    drawn = spark.createDataFrame([(0, "@startuml a @enduml")], "row_idx long, uml_code string")
    assert J.merge_responses(source, drawn).where("row_idx = 0").first().uml_valid


def test_unreadable_responses_stop_or_are_kept(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(response(0, "x") + "\n{cut off\n")
    lines = response_lines(spark, str(tmp_path))
    with pytest.raises(Exception, match="unreadable response line"):
        parse_responses(lines).collect()
    kept = parse_responses(lines, keep_unreadable=True).collect()
    assert {r.unreadable for r in kept} == {None, "{cut off"}


def test_files_belong_to_the_longest_listed_path(spark, tmp_path):
    for name in ("a/x 1/1.jsonl", "a/y/2.jsonl", "a/3.jsonl", "b/deep/er/4.jsonl", "c5.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(response(int(name[-7]), "t") + "\n")
    listed = [str(tmp_path / "a"), str(tmp_path / "a/x 1"), str(tmp_path / "b/*"), str(tmp_path / "{c,d}5.jsonl"), str(tmp_path / "a/y/2.jsonl")]
    rows = read_batch_responses(spark, listed).collect()
    assert sorted((r.row_idx, r.file_ord.listed) for r in rows) == [(1, 1), (2, 4), (3, 0), (4, 2), (5, 3)]
    with pytest.raises(ValueError, match="none of the listed"):
        responses._places(["file:/x/a"], ["file:/x/ab/1"])


def test_unreadable_lines_are_counted_by_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(f"{response(0, 'x')}\n\n{{cut off\n{response(1, 'y')}\n[1]\n")
    (tmp_path / "b.jsonl").write_text(response(2, "z") + "\n" + '{"response": null}' + "\n")
    (tmp_path / "c.jsonl").write_text(response(3, "z") + "\n")
    got = {r.file[-7:]: tuple(r)[1:] for r in unreadable_lines(response_lines(spark, str(tmp_path))).collect()}
    assert got == {"a.jsonl": (4, 2, "{cut off"), "b.jsonl": (2, 1, '{"response": null}'), "c.jsonl": (1, 0, None)}


def test_many_response_files_are_one_scan(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.jsonl").write_text(response(i, "x") + "\n")
    paths = [str(tmp_path / f"{i}.jsonl") for i in reversed(range(30))]
    lines = response_lines(spark, paths)
    assert lines._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert [r.file_ord.listed for r in lines.orderBy("file_ord").collect()] == list(range(30))


def test_ground_truth_needs_the_same_ids(spark):
    pred = spark.createDataFrame([(0, "p", "o"), (1, "q", "o")], "row_idx long, uml_pred string, uml_code_gt string")
    truth = spark.createDataFrame([(0, "a"), (7, "b")], "row_idx long, uml_code_gt string")
    with pytest.raises(ValueError):
        J.attach_ground_truth(pred, truth)


@pytest.mark.parametrize("condition", ["tikz_code <> ' code 3 '", "tikz_code IN (' code 0 ', ' code 1 ')", "tool = 'none'", "false"])
def test_filtered_rows_keep_the_ids_of_the_whole_table(spark, shards, condition):
    whole = {r.tikz_code: r.row_idx for r in with_row_index(read_shards(spark, shards)).collect()}
    rows = with_row_index(read_shards(spark, shards).where(condition)).collect()
    assert len(rows) == read_shards(spark, shards).where(condition).count()
    assert all(whole[r.tikz_code] == r.row_idx for r in rows)


def test_footers_are_counted_without_reading_columns(spark, shards):
    df = read_shards(spark, shards).where("tikz_code = ' code 9 '")
    assert table_rows(df) == 15
    plan = file_offsets(df)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_excluded_files_keep_folder_columns(spark, tmp_path):
    for split in ("a", "b"):
        spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/part=x {split}")
    name = read_shards(spark, str(tmp_path)).where("part = 'x a'").select("_metadata.file_name").first()[0]
    kept = read_shards(spark, str(tmp_path), exclude=[name])
    assert [r.part for r in kept.select("part").distinct().collect()] == ["x b"] and kept.count() == 3


def test_shards_in_parts(spark, tmp_path):
    """Shards that are folders of part files count as one file each, beside plain files."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    for name, ids in (("b.parquet/part-0", [3, 4]), ("b.parquet/part-1", [5]), ("a", [1, 2]), ("c.parquet/part-0", [9]), ("other/x", [8])):
        path = tmp_path / f"{name}.parquet"
        path.parent.mkdir(exist_ok=True)
        pq.write_table(pa.table({"i": ids}), path)
    df = read_shards(spark, str(tmp_path), exclude=["c.parquet"])
    rows = with_row_index(tag_split(df.withColumn("name", shard_name()), sep=".")).orderBy("i").collect()
    assert [tuple(r) for r in rows] == [
        (i + 1, "a.parquet" if i < 2 else "b.parquet", "a" if i < 2 else "b", i) for i in range(5)]
    assert exclude_files(df, ["b.parquet"]).count() == 2 and exclude_files(df, ["part-1.parquet"]).count() == 4
    assert read_shards(spark, str(tmp_path), exclude=["part-1.parquet", "c.parquet"]).count() == 4
    with pytest.raises(FileNotFoundError):
        read_shards(spark, str(tmp_path), exclude=["a.parquet", "b.parquet", "c.parquet"])


def test_files_of_a_query_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(queries, "FILE_BYTES", 100)
    df = queries._files(spark.range(50).withColumn("key", F.col("id")), "id", 3, 1000)
    assert len(df.inputFiles()) == 10
    assert [r.key for r in with_row_index(df).orderBy("row_idx").collect()] == list(range(50))


def in_files(spark, folder, rows, schema, sizes):
    start = 0
    for i, n in enumerate(sizes):
        spark.createDataFrame(rows[start:start + n], schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
        start += n
    return spark.read.parquet(*[f"{folder}/{i:03d}" for i in range(len(sizes))])


def test_truth_is_attached_by_position(spark, tmp_path):
    """Other file borders on either side, the predictions' ids and old truth left behind."""
    pred = in_files(spark, tmp_path / "p", [(f"p{i}", "old") for i in range(20)], "uml_pred string, uml_code_gt string", [3, 9, 8])
    truth = in_files(spark, tmp_path / "t", [(f"t{i}",) for i in range(20)], "uml_code string", [10, 1, 4, 5])
    got = J.attach_ground_truth_by_position(pred, truth)
    assert sorted((r.row_idx, r.uml_pred, r.uml_code_gt) for r in got.collect()) == [(i, f"p{i}", f"t{i}") for i in range(20)]
    some = J.attach_ground_truth_by_position(pred.where("uml_pred LIKE '%7'"), truth)
    assert sorted(r.uml_code_gt for r in some.collect()) == ["t17", "t7"]
    short = in_files(spark, tmp_path / "s", [(f"t{i}",) for i in range(19)], "uml_code string", [19])
    with pytest.raises(ValueError, match="20 rows on one side and 19"):
        J.attach_ground_truth_by_position(pred, short)


def test_models_without_ids_are_compared(spark, tmp_path):
    schema = "uml_pred string, uml_valid boolean, uml_error string, llm_failed boolean"
    rows = [(f"@startuml\na{i} b\n@enduml", True, "", False) for i in range(6)]
    base = in_files(spark, tmp_path / "b", rows, schema, [2, 4])
    tuned = in_files(spark, tmp_path / "f", rows[::-1], schema, [5, 1])
    truth = in_files(spark, tmp_path / "t", [(f"a{i} b",) for i in range(6)], "uml_code string", [1, 5])
    reports = compare_models(base, tuned, truth, str(tmp_path / "out"))
    means = {r.model: r.exact_match for r in reports["metric_means"].collect()}
    assert means == {"base": 1.0, "finetuned": 0.0}


def test_benchmark_job(spark, tmp_path):
    split = spark.createDataFrame([(b"1", "a"), (b"2", "b"), (b"3", "c"), (b"4", "d")], "image_bytes binary, uml_code string")
    split.coalesce(1).write.parquet(f"{tmp_path}/split")
    answers = spark.createDataFrame([(0, "@startuml x @enduml"), (1, "no"), (2, None)], "row_idx long, uml_code string")
    reports = run_benchmark(spark, f"{tmp_path}/split", answers, f"{tmp_path}/out")
    summary = reports["summary"].first()
    assert (summary.n, summary.valid, summary.llm_failures, summary.invalid) == (4, 1, 2, 1)
    assert [(r.uml_error, r.n_rows) for r in reports["top_errors"].collect()] == [(C.MISSING_START, 1)]
    rows = {r.row_idx: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert [rows[i].uml_code_gt for i in range(4)] == ["a", "b", "c", "d"] and rows[3].llm_failed and rows[2].uml_pred == ""


def test_null_ids_are_refused(spark):
    pred = spark.createDataFrame([(None, "p", "o"), (1, "q", "o")], "row_idx long, uml_pred string, uml_code_gt string")
    truth = spark.createDataFrame([(None, "a"), (1, "b")], "row_idx long, uml_code_gt string")
    with pytest.raises(ValueError, match="NULL"):
        J.attach_ground_truth(pred, truth)


def test_answers_missing_from_validation_are_checked(spark):
    source = spark.range(3).toDF("row_idx")
    answers = spark.createDataFrame([(0, "no diagram", None), (1, "no diagram", []), (2, "x", ["bad"])],
                                    "row_idx long, uml_code string, errors array<string>")
    rows = {r.row_idx: r for r in J.merge_responses(source, answers).collect()}
    assert [rows[i].uml_valid for i in range(3)] == [False, True, False]
    assert rows[0].uml_error == C.PREFLIGHT_MISSING_START


def test_labels_of_rows_without_batch(spark):
    df = spark.createDataFrame([(None, [1, 2]), (1, [3])], "batch int, input_ids array<int>")
    assert Q.mask_prompt_labels(df, [9], 0, batch="batch").count() == 2


@pytest.mark.parametrize("batches", [10, 1])
def test_arrays_move_only_for_many_batches(spark, monkeypatch, batches):
    monkeypatch.setattr(Q, "BROADCAST_BATCHES", batches)
    df = spark.createDataFrame([(i, i // 2, [1] * (i + 1)) for i in range(6)], "i int, batch int, input_ids array<int>")
    out = Q.mask_prompt_labels(df, [9], 0, batch="batch")
    assert [len(r.labels) for r in out.orderBy("i").collect()] == [2, 2, 4, 4, 6, 6]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("hashpartitioning" in plan) == (batches == 1) and "SortMergeJoin" not in plan


def test_a_later_failure_replaces_a_success(spark):
    rows = spark.createDataFrame([(0, "good", 0), (0, None, 1)], "row_idx long, uml_code string, line_no int")
    assert J.latest_response(rows, ["line_no"]).first().uml_code is None


def test_ingest_processes_each_file_once(spark, tmp_path):
    inbox, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    Path(inbox).mkdir()
    (Path(inbox) / "1.jsonl").write_text(response(0, "a") + "\n" + response(1, "b") + "\n")
    ingest_responses(spark, inbox, target, checkpoint).awaitTermination()
    (Path(inbox) / "2.jsonl").write_text(response(1, "c") + "\n")
    ingest_responses(spark, inbox, target, checkpoint).awaitTermination()
    ingest_responses(spark, inbox, target, checkpoint).awaitTermination()
    got = read_ingested(spark, target)
    assert got.count() == 3
    latest = J.latest_response(got, ["batch_id", "file_ord", "line_no"])
    assert {r.row_idx: r.uml_code for r in latest.collect()} == {0: "a", 1: "c"}


def test_store_is_joined_bucket_to_bucket(spark, tmp_path):
    """No exchange on the stored side; a new session's view of the same files; repeated batches replace."""
    columns = "row_idx long, uml_code string, file_ord string, block long, pos long"
    batch = lambda rows: spark.createDataFrame([(i, t, "f", 0, i) for i, t in rows], columns)
    store = ResultStore(spark, str(tmp_path / "s"), buckets=4)
    store.write(batch([(i, "old") for i in range(50)]), 0)
    store.write(batch([(i, "lost") for i in range(40, 45)]), 1)
    store.write(batch([(i, "new") for i in range(45, 60)] + [(0, None)]), 1)
    spark.sql(f"DROP TABLE {store.table}")
    again = ResultStore(spark, str(tmp_path / "s"), buckets=4)
    latest = {r.row_idx: r.uml_code for r in again.latest().collect()}
    assert latest == {0: None} | {i: "old" for i in range(1, 45)} | {i: "new" for i in range(45, 60)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pending = again.pending(spark.range(200).withColumnRenamed("id", "row_idx"))
        assert sorted(r.row_idx for r in pending.collect()) == list(range(60, 200))
        plan = pending._jdf.queryExecution().executedPlan().toString()
        # One exchange, over the rows that are asked about.
        assert plan.count("Exchange hashpartitioning") - plan.count("== Initial Plan ==") <= 1 and "Bucketed: true" in pending._jdf.queryExecution().toString()
        assert "Exchange" not in again.latest()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_conversion_is_resumed(spark, shards, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    store = ResultStore(spark, str(tmp_path / "store"), buckets=2)
    work = dict(path=shards, columns=["tikz_code"], responses=str(inbox), checkpoint=str(tmp_path / "c"), store=store,
                target=str(tmp_path / "out"))
    asked = lambda i: submit_batch(spark, shards, str(tmp_path / f"r{i}"), "text", "m", store=store).agg(
        F.sum("n_requests")).first()[0]
    assert asked(0) == 15
    (inbox / "1.jsonl").write_text("".join(response(i, "@startuml a @enduml") + "\n" for i in range(6)))
    first = resume_batch(spark, **work).where("scope = 'all'").first()
    assert (first.total, first.uml_valid) == (6, 6) and asked(1) == 9
    (inbox / "2.jsonl").write_text("".join(response(i, "nothing") + "\n" for i in range(5, 15)))
    last = resume_batch(spark, **work).where("scope = 'all'").first()
    assert (last.total, last.uml_valid) == (15, 5) and asked(2) is None


def test_keep_valid_tests_only_existing_columns(spark):
    df = spark.createDataFrame([(True, False), (True, None), (None, False), (False, False), (True, True)],
                               "uml_valid boolean, llm_failed boolean")
    assert [Q.keep_valid(d).count() for d in (df, df.drop("llm_failed"), df.drop("uml_valid"))] == [1, 3, 3]
    assert tuple(Q.kept_count(df).first()) == (1, 5)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 9, 10, 11, 57, 1000])
def test_exact_splits_have_exact_sizes(spark, n):
    df = spark.range(n).withColumn("row_idx", F.col("id") * 7 - 20).repartition(3)
    held = -(-n // 5)
    sizes = {r.split: r.n_rows for r in Q.split_sizes(Q.assign_exact_split(df)).collect()}
    want = {"train": n - held, "validation": held // 2, "test": -(-held // 2)}
    assert sizes == {k: v for k, v in want.items() if v}


def test_exact_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(200).toDF("row_idx")
    once, again = ({r.row_idx: r.split for r in Q.assign_exact_split(df.repartition(k)).collect()} for k in (1, 5))
    assert once == again
    other = {r.row_idx: r.split for r in Q.assign_exact_split(df, seed=7).collect()}
    assert once != other and Q.assign_exact_split(df.withColumn("split", F.lit("x"))).where("split = 'x'").count() == 200
    tied = spark.createDataFrame([(1,)] * 8 + [(2,), (None,)], "row_idx long")
    assert Q.assign_exact_split(tied).where("split IS NULL").count() == 1


def test_assign_split_is_stable(spark):
    df = spark.range(5000).toDF("row_idx")
    once = {r.row_idx: r.split for r in Q.assign_split(df).collect()}
    again = {r.row_idx: r.split for r in Q.assign_split(df.repartition(13)).collect()}
    assert once == again
    sizes = {r.split: r.n_rows for r in Q.split_sizes(Q.assign_split(df)).collect()}
    assert abs(sizes["train"] - 4000) < 150 and abs(sizes["test"] - 500) < 80
    kept = Q.assign_split(df.withColumn("split", F.lit("mine")))
    assert kept.select("split").distinct().collect()[0][0] == "mine"


@pytest.mark.parametrize("names, picked", [
    (["test", "train", "validation"], ("train", "validation")), (["train", "test"], ("train", "test")),
    (["b", "a"], ("a", None)), (["train"], ("train", None)), (["validation"], ("validation", "validation")),
])
def test_pick_splits(names, picked):
    assert Q.pick_splits(names) == picked


def test_mask_prompt_labels(spark):
    rows = [(0, [5, 1, 2, 7, 1, 2, 8]), (0, [5, 6]), (1, [1, 2]), (1, [9, 1, 2, 3, 4, 5, 6])]
    df = spark.createDataFrame(rows, "batch int, input_ids array<int>")
    got = [(r.input_ids, r.labels) for r in
           Q.mask_prompt_labels(df, [1, 2], pad_id=0, max_len=5, batch="batch").collect()]
    ign = C.IGNORED_LABEL
    assert ([5, 1, 2, 7, 1], [ign, ign, ign, 7, 1]) in got
    assert ([5, 6, 0, 0, 0], [5, 6, ign, ign, ign]) in got
    assert ([1, 2, 0, 0, 0], [ign] * 5) in got
    assert ([9, 1, 2, 3, 4], [ign, ign, ign, 3, 4]) in got
    assert Q.mask_prompt_labels(df, [1, 2], 0).select(F.max(F.size("labels"))).first()[0] == 7


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 'a "q", b\nc', "gt", 0.5, "test"), (1, "p", "gt", None, "train")],
                               "row_idx long, uml_error string, uml_code_gt string, bleu double, split string")
    write_results(df, f"{tmp_path}/res", partition_by="split")
    assert spark.read.parquet(f"{tmp_path}/res").where("split = 'test'").count() == 1
    export_split(df, "test", f"{tmp_path}/test")
    assert "split" not in spark.read.parquet(f"{tmp_path}/test").columns
    write_detail_csv(df, f"{tmp_path}/csv")
    import pandas as pd
    back = pd.concat(pd.read_csv(p) for p in Path(f"{tmp_path}/csv").glob("*.csv"))
    assert "uml_code_gt" not in back.columns and 'a "q", b\nc' in set(back["uml_error"])


def test_sample_rows(spark):
    df = spark.createDataFrame([(i, "x" * 200, b"i") for i in range(9, -1, -1)],
                               "row_idx long, text string, image_bytes binary")
    rows = Q.sample_rows(df).collect()
    assert [r.row_idx for r in rows] == [0, 1, 2, 3, 4]
    assert all(len(r.text) == 120 and "image_bytes" not in r for r in rows)


def test_submit_and_retrieve(spark, shards, tmp_path):
    sizes = submit_batch(spark, shards, str(tmp_path / "req"), "image", "m", cap=2000)
    assert sizes.agg(F.sum("n_requests")).first()[0] == 15
    (tmp_path / "r.jsonl").write_text("".join(response(i, f"@startuml\nA{i}\n@enduml") + "\n" for i in range(12)))
    manifest = spark.createDataFrame([("completed", "f"), ("running", None)], "status string, output_file_id string")
    args = (shards, ["tikz_code"])
    files = [str(tmp_path / "r.jsonl")]
    with pytest.raises(RuntimeError):
        retrieve_batch(spark, *args, manifest, files, str(tmp_path / "conv"))
    invalid = spark.createDataFrame([(3, ["bad"])], "row_idx long, errors array<string>")
    summary = retrieve_batch(spark, *args, manifest.limit(1), files, str(tmp_path / "conv"), invalid)
    got = {(r.scope, r.split): r for r in summary.collect()}
    assert (got["all", None].total, got["all", None].uml_valid, got["all", None].llm_failures) == (15, 11, 3)
    assert got["split", "test"].uml_valid == 3
    converted = spark.read.parquet(str(tmp_path / "conv")).withColumn("image_bytes", F.lit(b"i"))
    chats = prepare_training(converted, str(tmp_path / "test"))
    assert chats.count() == 11 and spark.read.parquet(str(tmp_path / "test")).count() == 3


def test_compare_models(spark, tmp_path):
    def side(shift):
        return spark.createDataFrame(
            [(i, f"a b c w{i + shift}", "", i % 4 > 0, "" if i % 4 else "bad", False) for i in range(12)],
            "row_idx long, uml_pred string, uml_code_gt string, uml_valid boolean, uml_error string, llm_failed boolean")
    truth = spark.createDataFrame([(i, f"a b c w{i}") for i in range(12)], "row_idx long, uml_code_gt string")
    reports = compare_models(side(1), side(0), truth, str(tmp_path))
    summary = {r.measure: r for r in reports["summary"].collect()}
    assert summary["exact_match"].base == 0 and summary["exact_match"].finetuned == 1
    assert summary["valid_pct"].base == 75
    assert {r.model: r for r in reports["validity_correctness"].collect()}["finetuned"].correct_pct == 75
    assert reports["scatter"].count() == 24
    assert all(r.arrow == "↑" for r in reports["delta"].collect())
    assert list(Path(f"{tmp_path}/metrics_detail_csv").glob("*.csv"))


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == shared_dir(spark)
