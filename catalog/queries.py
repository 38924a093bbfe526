"""``queries()``: one entry per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as V
from gradeloom.constants import FAILED_IN_BATCH
from gradeloom.functions.diagrams import check_diagram, preflight_diagram
from gradeloom.functions.messages import assistant_text
from gradeloom.functions.requests import parse_request_id, request_id
from gradeloom.functions.similarity import exact_match, token_prf, vector_cosine
from gradeloom.functions.text import normalise_code, strip_think
from gradeloom.operators import batches as B
from gradeloom.operators import curation as C
from gradeloom.operators import distributions as D
from gradeloom.operators import joins as J
from gradeloom.operators import reports as R
from gradeloom.operators import results as O
from gradeloom.operators import scoring as S
from gradeloom.operators.chunks import chunk_sizes, plan_request_chunks
from gradeloom.plans.benchmark import benchmark_rows
from gradeloom.plans.compare import score_models
from gradeloom.session import shared_dir, written
from gradeloom.sources.responses import parse_responses, read_batch_responses, response_lines, unreadable_lines
from gradeloom.sources.shards import read_shards, shard_name, tag_split, union_shards, with_row_index
from gradeloom.sources.sinks import export_split, write_detail_csv, write_request_chunks, write_results
from gradeloom.sources.splits import eval_split, ground_truth
from gradeloom.sources.store import ResultStore

Query = Callable[[SparkSession, str], DataFrame]
CHUNK_CAP = 100_000
# Of rows in one file written by a query, before compression.
FILE_BYTES = 64 << 20
# Ids of two words that follow each other in some documents and not in others.
HEADER = [301, 201]
_QUERIES: dict[str, Query] = {}


def query(name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, or under the name of its function."""
    def register(function: Query) -> Query:
        _QUERIES[name or function.__name__] = function
        return function
    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _scores(spark, sf_dir) -> DataFrame:
    """Scores of both models; the texts stay behind, for no report reads them."""
    return score_models(V.base_pairs(spark, sf_dir), V.finetuned_pairs(spark, sf_dir), detail=("row_idx", *V.FLAGS))


def _score_table(spark, sf_dir) -> DataFrame:
    """Scores as a written table, for reports that read them more than once."""
    return written(_scores(spark, sf_dir))


# Sources

@query("read_shards")
def read_shards_columns(spark, sf_dir):
    return read_shards(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "n_chars"])


@query()
def exclude_files(spark, sf_dir):
    return V.shards(spark, sf_dir)


@query("tag_split")
def tag_split_name(spark, sf_dir):
    return tag_split(V.shards(spark, sf_dir), sep=".")


@query()
def dense_row_index(spark, sf_dir):
    return with_row_index(tag_split(V.shards(spark, sf_dir), sep="."))


@query()
def filtered_row_index(spark, sf_dir):
    """Numbering after a filter gives the ids of the whole table."""
    docs = read_shards(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang"])
    return with_row_index(docs.where("lang = 'en'")).select("doc_id", "row_idx")


@query("union_shards")
def union_shards_rows(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    items = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return union_shards([docs, items])


@query()
def read_eval_split(spark, sf_dir):
    rows = V.flagged(spark, sf_dir)
    image = F.col("text").cast("binary")
    code = F.when(F.col("row_idx") % 2 == 0, F.col("text")).otherwise("")
    chat = C.format_training_chat(rows.select(
        "row_idx", F.col("text").alias("uml_code"), image.alias("image_bytes")))
    layouts = {
        "chat": chat.withColumn("row_idx", F.length("image_bytes").cast("long")),
        "source": rows.select("row_idx", F.struct(image.alias("bytes")).alias("sketch_image"),
                              code.alias("uml_code")),
        "flat": rows.select("row_idx", image.alias("image_bytes"), code.alias("uml_code")),
        "no_image": rows.select("row_idx", code.alias("uml_code")).withColumn("extra", F.lit(1)),
    }
    return union_shards([
        eval_split(df).select(F.lit(name).alias("layout"), F.length("image_bytes").cast("long").alias("n_bytes"),
                              "uml_code_gt") for name, df in layouts.items()])


@query()
def read_ground_truth(spark, sf_dir):
    chats = V.chats(spark, sf_dir)
    direct = chats.select("row_idx", F.nullif("text", F.lit("")).alias("uml_code"))
    return ground_truth(direct).withColumn("layout", F.lit("direct")).unionByName(
        ground_truth(chats.select("row_idx", "messages")).withColumn("layout", F.lit("messages")))


@query("read_batch_responses")
def read_response_files(spark, sf_dir):
    """Every document's response, written as JSON lines and read through the file reader."""
    paths = V.response_files(spark, sf_dir, _folder(spark))
    return read_batch_responses(spark, paths).select("row_idx", "uml_code", F.col("file_ord.listed").alias("file_ord"))


@query()
def unreadable_responses(spark, sf_dir):
    """Lines per listed folder, those of one source cut off in the middle."""
    docs = V.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("req_"), "doc_id").alias("custom_id"), "source", "text")
    line = F.to_json(F.struct("custom_id", "text"))
    cut = F.when(F.col("source") == "src0", F.left(line, F.length(line) - 1)).otherwise(line)
    path = _folder(spark)
    docs.select("source", cut.alias("line")).write.partitionBy("source").option("lineSep", "\n").text(path)
    found = unreadable_lines(response_lines(spark, path))
    return found.groupBy(F.regexp_extract("file", "source=([^/]*)/", 1).alias("source")).agg(
        F.sum("n_lines").alias("n_lines"), F.sum("n_unreadable").alias("n_unreadable"))


@query()
def resume_increment(spark, sf_dir):
    done = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_idx"))
    return J.resume_increment(V.flagged(spark, sf_dir).select("row_idx", "split"), done)


@query()
def resume_from_store(spark, sf_dir):
    """Rows without an answer in a store of two batches, and the last answer of the others."""
    store = ResultStore(spark, _folder(spark), buckets=8)
    rows = parse_responses(V.response_rows(spark, sf_dir), ("file_ord", "line_no")).select(
        "row_idx", "uml_code", F.lit("").alias("file_ord"), F.lit(0).cast("long").alias("block"),
        F.col("line_no").alias("pos"), F.col("file_ord").alias("batch"))
    for batch in (0, 1):
        store.write(rows.where(F.col("batch") == batch), batch)
    pending = store.pending(V.flagged(spark, sf_dir).select("row_idx"))
    return pending.select("row_idx", F.lit(None).cast("string").alias("uml_code"), F.lit(True).alias("pending")).unionByName(
        store.latest().withColumn("pending", F.lit(False)))


# Filters and result rows

@query()
def keep_valid(spark, sf_dir):
    return C.keep_valid(V.flagged(spark, sf_dir)).select("row_idx", "split")


@query()
def kept_count(spark, sf_dir):
    return C.kept_count(V.flagged(spark, sf_dir))


@query()
def classify_outcome(spark, sf_dir):
    outcome = O.classify_outcome(F.col("llm_failed"), F.col("uml_valid"))
    return V.pairs(spark, sf_dir).select("model", "row_idx", outcome.alias("outcome"))


@query()
def result_row(spark, sf_dir):
    code = F.when(F.col("row_idx") % 5 != 0, F.col("code"))
    preflight = preflight_diagram(F.col("code"))
    local = F.nullif(check_diagram(F.col("code"))["error"], F.lit(""))
    checked = V.diagrams(spark, sf_dir).select(
        "row_idx", code.alias("uml_code"),
        F.array_compact(F.array(preflight, local)).alias("errors"))
    return O.result_row(checked)


@query()
def fill_missing_text(spark, sf_dir):
    blanked = V.pairs(spark, sf_dir).withColumn("uml_pred", F.nullif("uml_pred", F.lit("")))
    return O.fill_missing_text(blanked).select("model", "row_idx", "uml_pred")


@query()
def empty_reference_count(spark, sf_dir):
    return O.empty_reference_count(ground_truth(V.chats(spark, sf_dir)))


@query()
def drop_source_columns(spark, sf_dir):
    chats = format_training_rows(spark, sf_dir)
    digest = {"split": F.col("split"), "image_bytes": F.length("image_bytes").cast("long"),
              "messages": F.md5(F.to_json("messages"))}
    return chats.select(*[digest.get(c, F.col(c)).alias(c) for c in chats.columns])


@query()
def sample_rows(spark, sf_dir):
    rows = V.flagged(spark, sf_dir).withColumn("image_bytes", F.col("text").cast("binary"))
    return C.sample_rows(rows)


# Joins and unions

@query()
def attach_results(spark, sf_dir):
    source = V.flagged(spark, sf_dir).select("row_idx", "split")
    answered = J.latest_response(parse_responses(
        V.response_rows(spark, sf_dir), ("file_ord", "line_no")))
    return J.attach_results(source, answered)


@query()
def attach_ground_truth(spark, sf_dir):
    truth = ground_truth(V.flagged(spark, sf_dir).select(
        "row_idx", F.upper("split").alias("uml_code")))
    return J.attach_ground_truth(V.base_pairs(spark, sf_dir), truth).select(
        "row_idx", "uml_pred", "uml_code_gt")


def _files(df: DataFrame, order: str, files: int, n_bytes: int) -> DataFrame:
    """The table in row order, without its order column, read again from ``files`` files or more:
    each is one task's, so ``n_bytes`` of rows are cut at ``FILE_BYTES``."""
    path = _folder(df.sparkSession)
    files = max(files, -(-n_bytes // FILE_BYTES))
    df.repartitionByRange(files, order).sortWithinPartitions(order).drop(order).write.parquet(path)
    return df.sparkSession.read.parquet(path)


@query()
def attach_ground_truth_by_position(spark, sf_dir):
    """Predictions and truth in files cut at different rows, neither with row ids."""
    predictions = V.base_pairs(spark, sf_dir).select("row_idx", F.col("row_idx").alias("key"), "uml_pred", "uml_code_gt")
    truth = V.flagged(spark, sf_dir).select("row_idx", F.upper("split").alias("uml_code"))
    # A prediction holds two texts of the documents, a truth only a split, beside their keys.
    texts, splits = V.table(spark, sf_dir, "documents").agg(*[
        F.coalesce(F.sum(F.coalesce(F.octet_length(c), F.lit(0)) + 16), F.lit(0)) for c in ("text", "source")]).first()
    return J.attach_ground_truth_by_position(
        _files(predictions, "row_idx", 3, 2 * texts), _files(truth, "row_idx", 7, splits)).select("key", "uml_pred", "uml_code_gt")


@query()
def benchmark_table(spark, sf_dir):
    rows = V.flagged(spark, sf_dir)
    split = eval_split(rows.select("row_idx", F.col("text").cast("binary").alias("image_bytes"),
                                   F.col("split").alias("uml_code")))
    return benchmark_rows(split, latest_response(spark, sf_dir))


@query()
def latest_response(spark, sf_dir):
    return J.latest_response(parse_responses(
        V.response_rows(spark, sf_dir), ("file_ord", "line_no")))


@query()
def merge_responses(spark, sf_dir):
    code = F.col("uml_code")
    wrapped = F.concat(F.lit("@startuml\n"), code, F.lit("\n@enduml"))
    answers = latest_response(spark, sf_dir).withColumn(
        "uml_code", F.when(F.col("row_idx") % 2 == 0, wrapped).otherwise(code))
    return J.merge_responses(V.flagged(spark, sf_dir), answers, FAILED_IN_BATCH)


@query()
def pair_models(spark, sf_dir):
    return J.pair_models(V.long_measures(V.pairs(spark, sf_dir)))


@query()
def union_models(spark, sf_dir):
    return V.pairs(spark, sf_dir)


# Sinks: written to a new folder and read back

def _folder(spark) -> str:
    return f"{shared_dir(spark)}/gradeloom/{uuid.uuid4().hex}"


@query("write_results")
def write_results_table(spark, sf_dir):
    path = _folder(spark)
    write_results(V.flagged(spark, sf_dir).drop("text"), path, partition_by="split")
    return spark.read.parquet(path).select("row_idx", "split", "uml_valid", "uml_error", "llm_failed")


@query("export_split")
def export_split_table(spark, sf_dir):
    path = _folder(spark)
    export_split(V.flagged(spark, sf_dir), "src0", path)
    return spark.read.parquet(path).select("row_idx", "text", "uml_valid", "llm_failed")


@query("write_detail_csv")
def write_detail_csv_table(spark, sf_dir):
    path = _folder(spark)
    write_detail_csv(V.base_pairs(spark, sf_dir), path)
    return spark.read.option("header", True).option("escape", '"').schema(
        "row_idx long, uml_valid boolean, uml_error string, llm_failed boolean").csv(path).select(
        "row_idx", "uml_valid", F.coalesce("uml_error", F.lit("")).alias("uml_error"), "llm_failed")


@query("write_request_chunks")
def write_request_files(spark, sf_dir):
    path = _folder(spark)
    write_request_chunks(build_request_text(spark, sf_dir), path, CHUNK_CAP)
    files = spark.read.option("lineSep", "\n").text(path)
    return files.groupBy(F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n_requests"))


@query()
def check_predictions(spark, sf_dir):
    return O.check_predictions(V.diagrams(spark, sf_dir).select("row_idx", F.col("code").alias("uml_pred"))).select(
        "row_idx", "uml_valid", "uml_error", "llm_failed")


# Reports

@query()
def shard_census(spark, sf_dir):
    files = tag_split(V.shards(spark, sf_dir), sep=".").select(
        "split", shard_name().alias("file_name"))
    return R.shard_census(files)


@query()
def split_census(spark, sf_dir):
    census = R.split_census(V.flagged(spark, sf_dir))
    return census.withColumn("splits", F.array_join("splits", ","))


@query()
def conversion_summary(spark, sf_dir):
    rows = V.flagged(spark, sf_dir)
    return V.rounded(R.conversion_summary(
        rows.withColumn("split", F.nullif("split", F.lit("src0")))))


@query()
def benchmark_summary(spark, sf_dir):
    return V.rounded(R.benchmark_summary(V.base_pairs(spark, sf_dir)))


@query()
def top_errors(spark, sf_dir):
    return R.top_errors(V.base_pairs(spark, sf_dir))


@query()
def outcome_comparison(spark, sf_dir):
    return V.rounded(R.outcome_comparison(V.pairs(spark, sf_dir)))


@query()
def outcome_shares(spark, sf_dir):
    return V.rounded(R.outcome_shares(V.pairs(spark, sf_dir)))


@query()
def split_sizes(spark, sf_dir):
    return C.split_sizes(V.flagged(spark, sf_dir))


@query()
def batch_gate(spark, sf_dir):
    return B.batch_gate(V.manifest(spark, sf_dir), by="job")


@query()
def batch_gate_overall(spark, sf_dir):
    return B.batch_gate(V.manifest(spark, sf_dir))


@query()
def batch_status_report(spark, sf_dir):
    return B.batch_status_report(V.manifest(spark, sf_dir)).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


# Text functions

@query("normalise_code")
def normalise(spark, sf_dir):
    return V.diagrams(spark, sf_dir).select("row_idx", normalise_code(F.col("code")).alias("body"))


@query("strip_think")
def strip_think_blocks(spark, sf_dir):
    noisy = F.concat(F.lit("\t<think>a\nb</think>\n"), "text", F.lit("<think>c</think> <think>open "))
    return V.flagged(spark, sf_dir).select("row_idx", strip_think(noisy).alias("text"))


@query("check_diagram")
def check_diagrams(spark, sf_dir):
    return V.diagrams(spark, sf_dir).select(
        "row_idx", check_diagram(F.col("code")).alias("c")).select("row_idx", "c.valid", "c.error")


@query("preflight_diagram")
def preflight_diagrams(spark, sf_dir):
    return V.diagrams(spark, sf_dir).select(
        "row_idx", preflight_diagram(F.col("code")).alias("error"))


@query()
def classify_render_response(spark, sf_dir):
    judged = O.classify_render_response(V.renders(spark, sf_dir))
    return judged.withColumn("errors", F.array_join("errors", "; "))


@query("assistant_text")
def assistant_turn(spark, sf_dir):
    chats = V.chats(spark, sf_dir)
    return chats.select("row_idx", assistant_text(
        F.col("messages"), chats.schema["messages"].dataType).alias("text"))


@query()
def assistant_turn_plain(spark, sf_dir):
    chats = V.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array(
            F.struct(F.col("role"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.lit("closing").alias("content")),
        ).alias("messages"))
    return chats.select("conv_id", "turn", assistant_text(
        F.col("messages"), chats.schema["messages"].dataType).alias("text"))


@query("build_request")
def build_request_text(spark, sf_dir):
    return B.build_request(V.flagged(spark, sf_dir), "text", "text", "model-a")


@query()
def build_request_image(spark, sf_dir):
    rows = V.flagged(spark, sf_dir).withColumn("image", F.col("text").cast("binary"))
    return B.build_request(rows, "image", "image", "model-a")


@query("request_id")
def request_ids(spark, sf_dir):
    ids = V.flagged(spark, sf_dir).select("row_idx", request_id(F.col("row_idx")).alias("custom_id"))
    return ids.withColumn("parsed", parse_request_id(F.col("custom_id")))


def format_training_rows(spark, sf_dir):
    rows = V.flagged(spark, sf_dir)
    return C.format_training_chat(C.keep_valid(rows).select(
        F.col("text").alias("uml_code"), F.struct(F.col("text").cast("binary").alias("bytes"))
        .alias("sketch_image"), "split"))


@query()
def format_training_chat(spark, sf_dir):
    def texts(m):
        return F.array_join(F.transform(m["content"], lambda p: F.concat_ws(":", p["type"], p["text"])), "|")
    chats = format_training_rows(spark, sf_dir)
    return chats.select(
        "split", F.length("image_bytes").cast("long").alias("n_bytes"),
        F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), texts(m))),
                     "||").alias("chat"))


@query()
def assign_split(spark, sf_dir):
    rows = V.flagged(spark, sf_dir).drop("split")
    return C.assign_split(rows).select("row_idx", "split")


@query()
def assign_exact_split(spark, sf_dir):
    rows = V.flagged(spark, sf_dir).drop("split")
    return C.assign_exact_split(rows).select("row_idx", "split")


@query()
def pick_splits(spark, sf_dir):
    split = F.when(F.col("uml_valid"), "train").when(F.col("llm_failed"), "test").otherwise("other")
    rows = V.flagged(spark, sf_dir).select("row_idx", split.alias("split"))
    train, held_out = C.train_eval(rows)
    return train.withColumn("role", F.lit("train")).unionByName(
        held_out.withColumn("role", F.lit("eval")))


@query()
def mask_prompt_labels(spark, sf_dir):
    masked = C.mask_prompt_labels(V.tokens(spark, sf_dir), HEADER, pad_id=0, batch="batch")
    return masked.select(
        "row_idx", F.size("input_ids").alias("width"),
        F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"))


@query("plan_request_chunks")
def plan_chunks(spark, sf_dir):
    lines = build_request_text(spark, sf_dir)
    return plan_request_chunks(lines, CHUNK_CAP, block_rows=256, fan_in=4)


@query()
def chunk_report(spark, sf_dir):
    lines = build_request_text(spark, sf_dir)
    return V.rounded(chunk_sizes(plan_request_chunks(lines, CHUNK_CAP)))


# Metrics

@query("exact_match")
def exact_matches(spark, sf_dir):
    return S.normalised(V.pairs(spark, sf_dir)).select(
        "model", "row_idx", exact_match(F.col("_pred"), F.col("_ref")).alias("exact_match"))


@query("token_prf")
def token_scores(spark, sf_dir):
    scored = S.normalised(V.pairs(spark, sf_dir)).select(
        "model", "row_idx", token_prf(F.col("_pred"), F.col("_ref")).alias("t"))
    return V.rounded(scored.select(
        "model", "row_idx", F.col("t.p").alias("token_prec"), F.col("t.r").alias("token_recall"),
        F.col("t.f1").alias("token_f1")))


@query()
def sentence_bleu(spark, sf_dir):
    return V.rounded(S.sentence_bleu(V.pairs(spark, sf_dir)).select("model", "row_idx", "bleu"))


@query()
def code_bleu(spark, sf_dir):
    return V.rounded(S.code_bleu(V.finetuned_pairs(spark, sf_dir)).select("row_idx", "codebleu"))


@query()
def tfidf_cosine(spark, sf_dir):
    return V.rounded(S.tfidf_cosine(V.base_pairs(spark, sf_dir)))


@query()
def tfidf_cosine_split(spark, sf_dir):
    """The same scores with a vocabulary that does not fit the broadcast."""
    return V.rounded(S.tfidf_cosine(V.base_pairs(spark, sf_dir), broadcast_terms=300))


@query("vector_cosine")
def vector_cosine_pairs(spark, sf_dir):
    """Each vector with the next one, the last with the first."""
    vectors = V.table(spark, sf_dir, "embeddings")
    edge = vectors.agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high")).first()
    before = F.when(F.col("vec_id") == edge.low, edge.high).otherwise(F.col("vec_id") - 1)
    following = vectors.select(before.alias("vec_id"), F.col("embedding").alias("other"))
    return V.rounded(vectors.join(following, "vec_id").select(
        "vec_id", vector_cosine(F.col("embedding"), F.col("other")).alias("cosine")))


@query()
def score_pairs(spark, sf_dir):
    return V.rounded(_scores(spark, sf_dir))


# Reports over scores

@query()
def available_metrics(spark, sf_dir):
    return R.available_metrics(_scores(spark, sf_dir))


@query()
def metric_means(spark, sf_dir):
    return V.rounded(R.metric_means(_scores(spark, sf_dir)))


@query()
def metric_summary(spark, sf_dir):
    return V.rounded(R.metric_summary(_scores(spark, sf_dir)))


@query()
def metric_delta(spark, sf_dir):
    return V.rounded(R.metric_delta(_scores(spark, sf_dir)))


@query()
def metric_scatter(spark, sf_dir):
    return V.rounded(D.metric_scatter(_scores(spark, sf_dir)))


@query()
def correctness_threshold(spark, sf_dir):
    return V.rounded(D.correctness_threshold(_score_table(spark, sf_dir)))


@query()
def validity_correctness(spark, sf_dir):
    return V.rounded(D.validity_correctness(_score_table(spark, sf_dir)))


@query()
def score_histogram(spark, sf_dir):
    return V.rounded(D.score_histogram(_score_table(spark, sf_dir), "token_f1"))


@query()
def score_density(spark, sf_dir):
    return V.rounded(D.score_density(_score_table(spark, sf_dir), "emb_sim"))

