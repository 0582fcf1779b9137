"""Queries over records: joins by key, summaries, splits, shards, lookups, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import records as R

from .registry import query, read


@query("length_cap_filter", r"""select doc_id, length(c)::bigint chars from (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') c from documents) where length(c) <= 2000""")
def length_cap_filter(spark: SparkSession, d: str) -> DataFrame:
    c = T.strip_images(T.strip_xml_declaration(F.col("text")))
    return read(spark, d, "documents").select("doc_id", F.length(c).cast("long").alias("chars")).where("chars <= 2000")


@query("dataset_include", "select doc_id, source from documents where lang in ('en', 'de')")
def dataset_include(spark: SparkSession, d: str) -> DataFrame:
    """An include list as given on a command line: trimmed, blanks dropped."""
    wanted = F.filter(F.transform(F.split(F.lit(" en, ,de "), ","), lambda x: F.trim(x)), lambda x: x != "")
    return read(spark, d, "documents").where(F.array_contains(wanted, F.col("lang"))).select("doc_id", "source")


@query("manifest_ids", "select distinct url id from pages")
def manifest_ids(spark: SparkSession, d: str) -> DataFrame:
    """The first word of each line of a manifest; blank lines are none."""
    lines = read(spark, d, "pages").select(F.concat(F.lit("  "), "url", F.lit(" extra")).alias("value")).unionAll(spark.createDataFrame([("  ",)], "value string"))
    return lines.where(T.strip(F.col("value")) != "").select(F.split(T.strip(F.col("value")), r"\s+")[0].alias("id")).distinct()


@query("incremental_skip", "select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    """Only what has no output yet."""
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("labelled_semi", "select doc_id, lang, source from documents where doc_id in (select doc_id from labels)")
def labelled_semi(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "lang", "source")


@query("paired_join", "select d.doc_id, d.n_chars, l.quality from documents d join labels l using (doc_id)")
def paired_join(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", "n_chars", "quality")


@query("missing_labels_anti", "select doc_id from documents d anti join labels l using (doc_id)")
def missing_labels_anti(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("meta_left_lookup", "select d.doc_id, coalesce(l.quality, -1) quality, coalesce(l.toxic, 0) toxic from documents d left join labels l using (doc_id)")
def meta_left_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return found.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("resume_filter", "select conv_id from conversations group by conv_id having count(*) < 4")
def resume_filter(spark: SparkSession, d: str) -> DataFrame:
    """Samples whose fourth candidate is not there yet."""
    turns = read(spark, d, "conversations")
    numbered = turns.select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("k"))
    return turns.select("conv_id").distinct().join(numbered.where("k = 4"), "conv_id", "left_anti")


@query("tick_label_lookup", "select o_orderkey, o_custkey % 5 as pos, case o_custkey % 5 when 0 then 'Jan' when 1 then 'Feb' when 2 then 'Mar' end as label, o_custkey % 5 > 2 as hidden from orders")
def tick_label_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Labels by place from a small table; places without one are hidden."""
    labels = spark.createDataFrame([(0, "Jan"), (1, "Feb"), (2, "Mar")], "pos long, label string")
    found = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("pos")).join(F.broadcast(labels), "pos", "left")
    return found.select("o_orderkey", "pos", "label", F.col("label").isNull().alias("hidden"))


@query("tick_prefix", "with k as (select l_orderkey, min(l_linenumber) filter (l_returnflag = 'N') m from lineitem group by 1) select l.l_orderkey, l.l_linenumber from lineitem l join k using (l_orderkey) where m is null or l_linenumber < m")
def tick_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a document before its first sentinel."""
    li = read(spark, d, "lineitem")
    first = li.groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") == "N", F.col("l_linenumber"))).alias("m"))
    return li.join(first, "l_orderkey").where("m is null or l_linenumber < m").select("l_orderkey", "l_linenumber")


@query("chat_records", """select doc_id, json_object('messages', [{'role': 'system', 'content': lang}, {'role': 'user', 'content': '<image>Convert this image to SVG code.'}, {'role': 'assistant', 'content': source}], 'images', [doc_id || '.png'])::varchar record from documents""")
def chat_records(spark: SparkSession, d: str) -> DataFrame:
    record = R.chat_record(F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".png")), system=F.col("lang"))
    return read(spark, d, "documents").select("doc_id", F.to_json(record).alias("record"))


@query("conversation_text", "select conv_id, count(*)::bigint turns, md5(string_agg(role || ':' || text, '|' order by turn)) digest from conversations group by conv_id")
def conversation_text(spark: SparkSession, d: str) -> DataFrame:
    m = R.conversation_messages(read(spark, d, "conversations"))
    joined = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return m.select("conv_id", F.size("messages").cast("long").alias("turns"), F.md5(joined).alias("digest"))


@query("last_assistant_response", """
    select conv_id, md5(coalesce(max_by(text, turn) filter (role = 'assistant'), 'fallback')) answer, md5(coalesce(max_by(text, turn) filter (role = 'user'), '')) question from conversations group by conv_id""")
def last_assistant_response(spark: SparkSession, d: str) -> DataFrame:
    m = R.conversation_messages(read(spark, d, "conversations"))
    return m.select("conv_id", F.md5(R.assistant_response(F.col("messages"), F.lit(""), F.lit("fallback"))).alias("answer"), F.md5(F.coalesce(R.last_of_role(F.col("messages"), "user"), F.lit(""))).alias("question"))


@query("image_entry", "select doc_id, case doc_id % 4 when 0 then source when 1 then lang when 2 then 'first' end path from documents")
def image_entry(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    entry = F.when(k == 0, F.create_map(F.lit("other"), F.lit("x"), F.lit("path"), F.col("source"))).when(k == 1, F.create_map(F.lit("url"), F.col("lang"), F.lit("w"), F.lit("x"))).when(k == 2, F.create_map(F.lit("q"), F.lit("first"), F.lit("w"), F.lit("x")))
    return read(spark, d, "documents").select("doc_id", R.image_path(entry).alias("path"))


@query("token_length_stats", r"""
    with t as (select lang, case when w = '' then 0 else len(regexp_split_to_array(w, '\s+')) end + 1350 t from (select lang, regexp_replace(text, '^\s+|\s+$', '', 'g') w from documents)),
    a as (select lang, grouping(lang)::int total, count(*)::bigint valid, coalesce(max(t), 0)::bigint maximum, count(*) filter (t > 1500)::bigint over_1500, count(*) filter (t > 2000)::bigint over_2000 from t group by rollup (lang))
    select lang, total, valid, maximum, over_1500, format('{:.2f}', 100.0::double * over_1500 / valid) || '%' share_1500, over_2000, format('{:.2f}', 100.0::double * over_2000 / valid) || '%' share_2000 from a""")
def token_length_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.length_report(read(spark, d, "documents"), T.word_count(F.col("text")), "lang", (1500, 2000))


@query("long_examples_top5", "select doc_id, n_chars from documents where n_chars > 3000 order by doc_id limit 5")
def long_examples_top5(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("n_chars > 3000").select("doc_id", "n_chars").orderBy("doc_id").limit(5)


@query("last_wins_dedup", "select lang, source, max(doc_id) doc_id, max_by(n_chars, doc_id) n_chars from documents group by lang, source")
def last_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    return R.last_wins(read(spark, d, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], ["doc_id"])


@query("hash_split_train_test", """
    with h as (select doc_id, list_reduce(list_prepend(0::bigint, list_transform(string_split(source || doc_id, ''), lambda x: unicode(x)::bigint)), lambda a, x: (a * 31 + x) & 4294967295) h from documents)
    select doc_id, case when h % 1000 < 100 then 'test' else 'train' end split from h""")
def hash_split_train_test(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat("source", F.col("doc_id").cast("string"))
    return read(spark, d, "documents").select("doc_id", R.hash_split(key).alias("split"))


@query("eval_head", "select doc_id from documents order by doc_id limit 50")
def eval_head(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(50)


@query("contiguous_shard", "select o_orderkey, (ntile(7) over (order by o_orderkey) - 1)::bigint shard from orders")
def contiguous_shard(spark: SparkSession, d: str) -> DataFrame:
    return R.contiguous_shards(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7).select("o_orderkey", "shard")


@query("batch_id", "select o_orderkey, ((row_number() over (order by o_orderdate, o_orderkey) - 1) // 32)::bigint batch from orders")
def batch_id(spark: SparkSession, d: str) -> DataFrame:
    return R.batches(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 32).select("o_orderkey", "batch")


@query("candidate_numbers", "select conv_id, turn, row_number() over (partition by conv_id order by turn)::bigint k from conversations")
def candidate_numbers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long").alias("k"))


@query("latest_checkpoint", """
    with n as (select o_custkey, case when o_orderkey % 5 = 0 then 'final' else 'checkpoint-' || o_orderkey end as name, case when o_orderkey % 5 = 0 then 0 else o_orderkey end as step from orders)
    select o_custkey, arg_max(name, (step, name)) latest from n group by o_custkey""")
def latest_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    named = read(spark, d, "orders").select("o_custkey", F.when(key % 5 == 0, "final").otherwise(F.concat(F.lit("checkpoint-"), key.cast("string"))).alias("name"))
    return R.latest(named, F.col("name"), "o_custkey")


@query("quantile_summary", """
    select lang, min(n_chars)::double as lowest, quantile_cont(n_chars, 0.01) p01, quantile_cont(n_chars, 0.05) p05, quantile_cont(n_chars, 0.5) p50, round(avg(n_chars), 6) mean,
        quantile_cont(n_chars, 0.95) p95, quantile_cont(n_chars, 0.99) p99, max(n_chars)::double as highest from documents group by lang""")
def quantile_summary(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("n_chars", F.array(*[F.lit(x) for x in (0.01, 0.05, 0.5, 0.95, 0.99)]))
    out = read(spark, d, "documents").groupBy("lang").agg(F.min("n_chars").cast("double").alias("lowest"), q.alias("q"), F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").cast("double").alias("highest"))
    return out.select("lang", "lowest", *[F.col("q")[i].alias(n) for i, n in enumerate(("p01", "p05", "p50", "p95", "p99"))], "mean", "highest")


@query("empty_summary", "select count(*)::bigint n, quantile_cont(n_chars, 0.5) median from documents where n_chars < 0")
def empty_summary(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of no rows are null, not an error."""
    return read(spark, d, "documents").where("n_chars < 0").agg(F.count("*").alias("n"), F.percentile("n_chars", F.lit(0.5)).alias("median"))


@query("worst_20", "select doc_id, quality, n_chars from documents join labels using (doc_id) order by quality, n_chars desc, doc_id limit 20")
def worst_20(spark: SparkSession, d: str) -> DataFrame:
    both = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", "quality", "n_chars")
    return both.orderBy("quality", F.desc("n_chars"), "doc_id").limit(20)


@query("screen_mismatch", """
    with p as (select a.vec_id a, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) s from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
    select a, s < 0.05 and (a % 3 = 0 or a % 5 = 0) suspicious from p""")
def screen_mismatch(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    x = e.select(F.col("vec_id").alias("a"), F.col("embedding").cast("array<double>").alias("x"))
    y = e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").cast("array<double>").alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    s = dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))
    return x.join(y, "a").select("a", ((s < 0.05) & ((F.col("a") % 3 == 0) | (F.col("a") % 5 == 0))).alias("suspicious"))


@query("compression_stats", r"""
    with p as (select (page_id % 4)::varchar dataset, length(html) a, length(regexp_replace(html, '\s+', ' ', 'g')) b from pages)
    select dataset, grouping(dataset)::int total, count(*)::bigint processed_count, round(sum(b) / count(*)::double, 6) avg_length, round((sum(a) - sum(b)) * 100.0::double / sum(a), 6) reduction_percent from p group by rollup (dataset)""")
def compression_stats(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").withColumn("dataset", (F.col("page_id") % 4).cast("string"))
    return R.compression(pages, F.length("html"), F.length(F.regexp_replace("html", r"\s+", " ")), "dataset")


@query("metric_rows", """
    with m as (select count(*)::double processed_count, round(avg(length(html)), 6) avg_length from pages)
    select 'processed_count' as metric, processed_count as value from m union all select 'avg_length', avg_length from m""")
def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    wide = read(spark, d, "pages").agg(F.count("*").cast("double").alias("processed_count"), F.round(F.avg(F.length("html")), 6).alias("avg_length"))
    return wide.unpivot([], ["processed_count", "avg_length"], "metric", "value")


@query("task_outcomes", "select source dataset, count(*) filter (n_chars > 500)::bigint succeeded, count(*) filter (n_chars <= 500)::bigint failed, coalesce(array_to_string(list_slice(list(doc_id order by doc_id) filter (n_chars <= 500), 1, 20), ','), '') sample from documents group by source")
def task_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Successes, failures and the first twenty failures of each group; twenty are kept in the partial sums already."""
    docs = read(spark, d, "documents").select(F.col("source").alias("dataset"), "doc_id", (F.col("n_chars") > 500).alias("ok"))
    counts = docs.groupBy("dataset").agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    first = docs.where("not ok").withColumn("k", F.row_number().over(W.partitionBy("dataset").orderBy("doc_id"))).where("k <= 20")
    lists = first.groupBy("dataset").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("sample"))
    return counts.join(lists, "dataset", "left").select("dataset", "succeeded", "failed", F.coalesce("sample", F.lit("")).alias("sample"))


@query("skip_missing", "select source dataset, count(*) filter (l.doc_id is not null and trim(text) <> '')::bigint records, count(*) filter (l.doc_id is null or trim(text) = '')::bigint skipped from documents d left join labels l using (doc_id) group by source")
def skip_missing(spark: SparkSession, d: str) -> DataFrame:
    both = read(spark, d, "documents").join(read(spark, d, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    ok = F.coalesce(F.col("there") & (T.strip(F.col("text")) != ""), F.lit(False))
    return both.groupBy(F.col("source").alias("dataset")).agg(F.count_if(ok).alias("records"), F.count_if(~ok).alias("skipped"))


@query("renamed_outputs", "select case when source = 'src3' then 'graphiq' else source end as name, count(*)::bigint n from documents group by 1")
def renamed_outputs(spark: SparkSession, d: str) -> DataFrame:
    named = F.when(F.col("source") == "src3", "graphiq_clean").otherwise(F.col("source"))
    return read(spark, d, "documents").groupBy(R.output_name(named).alias("name")).agg(F.count("*").alias("n"))


@query("sync_repaired", "select doc_id, case when doc_id % 3 = 0 then lower(source) else upper(source) end svg from documents")
def sync_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Only repaired rows take the cleaned text over."""
    return read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lower("source")).otherwise(F.upper("source")).alias("svg"))


@query("id_union", "select page_id id from pages union select doc_id from labels")
def id_union(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select(F.col("page_id").alias("id")).union(read(spark, d, "labels").select("doc_id")).distinct()


@query("vocab_ops", """
    with v as (select distinct unnest(string_split(lower(p_name), ' ')) token from part), w as (select distinct lower(p_brand) token from part union select distinct lower(p_type) from part)
    select token, 'new' as kind from (select token from w except select token from v) union all select token, 'known' from v""")
def vocab_ops(spark: SparkSession, d: str) -> DataFrame:
    """Union of vocabularies, and the tokens that extend one."""
    part = read(spark, d, "part")
    known = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("token")).distinct()
    wanted = part.select(F.lower("p_brand").alias("token")).union(part.select(F.lower("p_type"))).distinct()
    return wanted.exceptAll(known).distinct().withColumn("kind", F.lit("new")).unionAll(known.withColumn("kind", F.lit("known")))


@query("token_descriptions", "select p_partkey, case p_size % 3 when 0 then 'a rectangle' when 1 then 'a circle' else 'line' end as description from part")
def token_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """A description by token, else by the token without brackets, else the bare token."""
    vocab = spark.createDataFrame([("[<|rect|>]", "a rectangle"), ("circle", "a circle")], "token string, description string")
    token = F.when(F.col("p_size") % 3 == 0, "[<|rect|>]").when(F.col("p_size") % 3 == 1, "[<|circle|>]").otherwise("[<|line|>]")
    t = read(spark, d, "part").select("p_partkey", token.alias("token"), F.regexp_replace(token, r"[\[\]<>|]", "").alias("bare"))
    by_token, by_bare = vocab.withColumnRenamed("description", "d1"), vocab.select(F.col("token").alias("bare"), F.col("description").alias("d2"))
    return t.join(F.broadcast(by_token), "token", "left").join(F.broadcast(by_bare), "bare", "left").select("p_partkey", F.coalesce("d1", "d2", "bare").alias("description"))


@query("map_merge", "select p_partkey, p_size::varchar as width, 'new' as fill, 2::bigint n from part")
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    """Merged maps in which the later of equal keys counts, whatever the session's policy for duplicates."""
    size = F.col("p_size").cast("string")
    a, b = F.create_map(F.lit("fill"), F.lit("old"), F.lit("width"), size), F.create_map(F.lit("fill"), F.lit("new"))
    merged = F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)
    return read(spark, d, "part").select("p_partkey", F.element_at(merged, "width").alias("width"), F.element_at(merged, "fill").alias("fill"), F.size(merged).cast("long").alias("n"))


@query("column_subset", "select p_partkey, p_size % 2 = 0 as ok from part")
def column_subset(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("z")))
    return read(spark, d, "part").select("p_partkey", (F.size(F.array_except(wanted, F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == 0).alias("ok"))


@query("class_overlap", "select p_partkey, p_size % 3 = 0 as horizontal from part")
def class_overlap(spark: SparkSession, d: str) -> DataFrame:
    classes = F.when(F.col("p_size") % 3 == 0, "axis bottom").otherwise("axis bottoms")
    return read(spark, d, "part").select("p_partkey", F.arrays_overlap(F.split(classes, " "), F.array(F.lit("bottom"), F.lit("top"))).alias("horizontal"))


@query("appended_datasets", "select 'a' as part, count(*)::bigint n from documents union all select 'b', count(*) from pages")
def appended_datasets(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "documents").select(F.lit("a").alias("part"), F.col("text").alias("body"))
    b = read(spark, d, "pages").select(F.col("html").alias("body"), F.lit("b").alias("part"))
    return a.unionByName(b).groupBy("part").agg(F.count("*").alias("n"))


@query("multiset_score", r"""
    with w as (select doc_id, list_transform(range(0, 12), lambda i: (doc_id * 7 + i * i) % 9) a, list_transform(range(0, 10), lambda i: (doc_id + i * 3) % 9) b from documents),
    c as (select doc_id, x, count(*) filter (s = 1) na, count(*) filter (s = 2) nb from (select doc_id, unnest(a) x, 1 s from w union all select doc_id, unnest(b), 2 from w) group by doc_id, x)
    select doc_id, round(sum(least(na, nb)) / (22.0::double - sum(least(na, nb))), 9) score from c group by doc_id""")
def multiset_score(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    a = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (doc * 7 + i * i) % 9)
    b = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (doc + i * 3) % 9)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return read(spark, d, "documents").select("doc_id", F.round(both / (F.size(a) + F.size(b) - both), 9).alias("score"))


@query("judged_mean", "select conv_id, avg(case when turn % 3 = 0 then 1.0 else 0.0 end)::double reward from conversations group by conv_id")
def judged_mean(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("turn") % 3 == 0, "[[YES]]").otherwise("[[NO]]")
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.avg(T.yes_no(said)), F.lit(0.0)).alias("reward"))


@query("best_of_scores", "select doc_id, greatest(quality, toxic)::double as best from labels")
def best_of_scores(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").select("doc_id", F.greatest(F.col("quality").cast("double"), F.nanvl(F.col("toxic").cast("double"), F.lit(0.0))).alias("best"))


@query("test_pass_rate", "select conv_id, round(avg(case when length(text) % 2 = 0 then 1.0 else 0.0 end), 9)::double rate from conversations group by conv_id")
def test_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    ok = F.length("text") % 2 == 0
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.round(F.avg(ok.cast("double")), 9).alias("rate"))


@query("trajectory_last", "select conv_id, max(turn) turn, md5(max_by(text, turn)) digest from conversations group by conv_id")
def trajectory_last(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.md5(F.max_by("text", "turn")).alias("digest"))


@query("debug_slice", "select page_id from pages order by page_id limit 10 offset 7")
def debug_slice(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id").orderBy("page_id").offset(7).limit(10)


@query("json_calls", "select conv_id, turn, 'f' || turn as name, (turn * 2)::bigint as x, 1::bigint as bad from conversations")
def json_calls(spark: SparkSession, d: str) -> DataFrame:
    """Newline-separated JSON objects; lines that aren't JSON are null."""
    k = F.col("turn").cast("string")
    body = F.concat(F.lit('{"name":"f'), k, F.lit('","parameters":{"x":'), (F.col("turn") * 2).cast("string"), F.lit("}}\nnot json"))
    calls = F.transform(F.split(body, "\n"), lambda s: F.from_json(s, "name string, parameters map<string,bigint>"))
    return read(spark, d, "conversations").select("conv_id", "turn", calls[0]["name"].alias("name"), calls[0]["parameters"]["x"].alias("x"), F.size(F.filter(calls, lambda c: c["name"].isNull())).cast("long").alias("bad"))


@query("viewport_meta", "select o_orderkey, case when o_custkey % 2 = 0 then 1 else 0 end as known from orders")
def viewport_meta(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    meta = orders.select("o_custkey").distinct().where("o_custkey % 2 = 0").withColumn("scale", F.lit(1.0))
    return orders.join(meta, "o_custkey", "left").select("o_orderkey", F.col("scale").isNotNull().cast("int").alias("known"))


