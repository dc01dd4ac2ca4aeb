"""The registered queries of the engine's own operators, each with DuckDB SQL for the same rows where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import metrics
from lodestack.functions import text as fn
from lodestack.operators import chunking, context, coverage, evaluation, joins, prompts, retrieval
from lodestack.plans import runs
from lodestack.runtime import materialize, table
from lodestack.sources import readers, settings

QUERIES: dict = {}
ORACLES: dict = {}
WS = fn.SPACE
NOT_WS = fn.NOT_SPACE


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


# --- pieces of oracle SQL

PUNCT = fn.PUNCTUATION.replace("'", "''")


def norm(x: str) -> str:
    article = lambda s: rf"regexp_replace({s}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \3', 'g')"
    return f"trim(regexp_replace({article(article(f"translate(lower({x}), '{PUNCT}', '')"))}, '{WS}+', ' ', 'g'))"


def words(x: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({x}), '([\x{{4E00}}-\x{{9FA5}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}_]+')"


def spaced(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def sents(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({x}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)), lambda w: regexp_matches(w, '{NOT_WS}'))"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as text, unnest(range(0, len(string_split(text, chr(10)))))::int as pos from documents where text is not null)"
SPLITS = f"{LINES}, splits as (select doc_id, pos as split_idx, text || chr(10) as text, case when pos = 0 then 1 else 1 + pos % 3 end::int as level from lines)"
CHUNKS = f"""s as (select doc_id, unnest({sents("text")}) as t, unnest(range(1, len({sents("text")}) + 1)) as i from documents),
n as (select doc_id, t, i, len({words("t")}) as n from s),
walk as (select doc_id, i, n as used, 0 as chunk from n where i = 1
  union all select n.doc_id, n.i, case when w.used + n.n <= 200 then w.used + n.n else n.n end, w.chunk + case when w.used + n.n <= 200 then 0 else 1 end from walk w join n on n.doc_id = w.doc_id and n.i = w.i + 1),
chunks as (select doc_id, chunk::int as ordinal, {stripped("string_agg(t, '' order by i)")} as text from walk join n using (doc_id, i) group by doc_id, chunk)"""
PAIRS = "pairs as (select a.conv_id, a.turn, a.text as pred, b.text as truth from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def splits_of(docs: DataFrame) -> DataFrame:
    """Lines as splits, with levels 1, 2, 3 by position."""
    level = F.when(F.col("pos") == 0, 1).otherwise(1 + F.col("pos") % 3)
    return lines_of(docs).select("doc_id", F.col("pos").alias("split_idx"), F.concat("text", F.lit("\n")).alias("text"), level.cast("int").alias("level"))


def pairs_of(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the next one of its conversation."""
    turns = table(spark, d, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    gap = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")) - F.col("turn")
    return turns.select("conv_id", "turn", F.col("text").alias("pred"), after.alias("truth"), gap.alias("_g")).where("_g = 1").drop("_g")


# --- text functions


@query(f"select doc_id, len({words('text')})::int as n_words, round(1.2 * len({spaced('text')}))::int as n_estimated from documents")
def word_len(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.word_len(F.col("text")).alias("n_words"), fn.count_words(F.col("text")).alias("n_estimated"))


@query(f"select doc_id, {norm('text')} as normal from documents")
def normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.normalize_answer(F.col("text")).alias("normal"))


@query(f"select doc_id, regexp_replace(translate(lower(text), '{PUNCT}{fn.CJK_PUNCTUATION}', ''), '{WS}+', '', 'g') as normal from documents")
def normalize_zh(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.normalize_zh_answer(F.col("text")).alias("normal"))


@query(f"select doc_id, i::int as i, s from (select doc_id, unnest({sents('text')}) as s, unnest(range(0, len({sents('text')}))) as i from documents)")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(fn.sentences_en(F.col("text"))).alias("i", "s"))


@query(f"""with recursive s as (select doc_id, unnest({sents('text')}) as x, unnest(range(0, len({sents('text')}))) as i from documents),
c as (select doc_id, {stripped('x')} as x, row_number() over (partition by doc_id order by i) as i from s where {stripped('x')} <> ''),
walk as (select doc_id, i, x as joined from c where i = 1
  union all select c.doc_id, c.i, case when length(w.joined) < 10 then w.joined || ' ' || c.x else c.x end from walk w join c on c.doc_id = w.doc_id and c.i = w.i + 1),
done as (select doc_id, i, joined from walk where length(joined) >= 10 or (doc_id, i) in (select doc_id, max(i) from c group by doc_id))
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as i, joined as s from done""")
def sentences_merged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(fn.merge_short_sentences(fn.sentences_en(F.col("text")))).alias("i", "s"))


@query(r"select doc_id, case when length(text) > 200 and not regexp_matches(text, '[\x{4E00}-\x{9FA5}]') then left(text, 150) || right(text, 50) when length(text) > 20 and regexp_matches(text, '[\x{4E00}-\x{9FA5}]') then left(text, 15) || right(text, 5) else text end as cut from documents")
def truncate_sentence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.truncate_sentence(F.col("text"), 15, 5).alias("cut"))


@query(f"with {LINES}, h as (select doc_id, pos, repeat('#', (pos % 4)::int) || case when pos % 4 > 0 then ' ' else '' end || text as l from lines) select doc_id, pos, length(replace(regexp_extract(l, '^[ #]*'), ' ', ''))::int as level, case when length(replace(regexp_extract(l, '^[ #]*'), ' ', '')) > 0 then regexp_replace(l, '^[ #]*', '# ') else l end as line from h")
def headings(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("pos") % 4
    rows = lines_of(table(spark, d, "documents")).select("doc_id", "pos", F.concat(F.repeat(F.lit("#"), n), F.when(n > 0, " ").otherwise(""), F.col("text")).alias("l"))
    return rows.select("doc_id", "pos", fn.heading_level(F.col("l")).alias("level"), fn.replace_heading(F.col("l"), "# ").alias("line"))


@query(f"with w as (select doc_id, {spaced('text')} as t from documents) select doc_id, array_to_string(case when len(t) > 100 then list_concat(t[1:50], t[len(t) - 49:]) else t end, ' ') as cut from w")
def middle_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(fn.middle_truncate(fn.split_space(F.col("text")), 100), " ").alias("cut"))


# --- chunking


@query(f"with recursive {CHUNKS} select doc_id, ordinal, doc_id || '_' || ordinal as chunk_id, text from chunks")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_chunks(table(spark, d, "documents"))


@query(f"with {SPLITS}, g as (select *, sum(case when level <= 2 or split_idx = 0 then 1 else 0 end) over (partition by doc_id order by split_idx) - 1 as g from splits) select doc_id, g::int as split_idx, string_agg(text, '' order by split_idx) as text, arg_min(level, split_idx) as level from g group by doc_id, g")
def level_clamp(spark: SparkSession, d: str) -> DataFrame:
    return chunking.clamp_levels(splits_of(table(spark, d, "documents")), 2)


@query()
def over_chunk_merge(spark: SparkSession, d: str) -> DataFrame:
    return chunking.merge_splits(splits_of(table(spark, d, "documents")), 100)


NODES = f"""{SPLITS}, deep as (select doc_id, split_idx as i, level, depth from splits, (select unnest(range(0, 11)) as depth)),
g as (select *, sum(case when i > 0 and level <= depth then 1 else 0 end) over (partition by doc_id, depth order by i) as g from deep),
spans as (select doc_id, depth, min(i) as lft, max(i) + 1 as rgt from g group by doc_id, depth, g),
nodes as (select s.*, p.lft as parent_lft from spans s left join spans p on p.doc_id = s.doc_id and p.depth = s.depth - 1 and p.lft <= s.lft and s.rgt <= p.rgt where s.depth = 0 or p.rgt - p.lft > 1)"""


@query(f"with {NODES} select n.doc_id, n.depth::int as depth, n.lft::int as lft, n.rgt::int as rgt, n.parent_lft::int as parent_lft, (select count(*) from nodes c where c.doc_id = n.doc_id and c.depth = n.depth + 1 and c.parent_lft = n.lft)::int as n_children from nodes n")
def hi_tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return chunking.tree_nodes(splits_of(table(spark, d, "documents")))


POINTS = "points as (select doc_id, pos as p, (1 + pos % 2)::int as level from lines where pos % 3 = 0 union all select doc_id, pos, 3 from lines where pos % 6 = 0)"


@query(f"with {LINES}, {POINTS}, c as (select doc_id, p as pos, max(level) as lv from points where p > 0 group by all), g as (select lines.*, lv, sum(case when lv is not null then 1 else 0 end) over (partition by doc_id order by pos) as g from lines left join c using (doc_id, pos)) select doc_id, g::int as split_idx, string_agg(text, '' order by pos) as text, coalesce(arg_min(coalesce(lv, 1), pos), 1)::int as level from g group by doc_id, g")
def points_to_splits(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(table(spark, d, "documents"))
    every = lines.where("pos % 3 = 0").select("doc_id", F.col("pos").alias("p"), (1 + F.col("pos") % 2).cast("int").alias("level"))
    points = every.union(lines.where("pos % 6 = 0").select("doc_id", F.col("pos").alias("p"), F.lit(3)))
    return chunking.points_to_splits(points, lines)


@query(f"with {LINES}, a as (select doc_id, pos, length(text) % 50 as p, pos % 2 as l from lines), b as (select *, lag(p) over (partition by doc_id, l order by pos) as before from a) select doc_id, (l + 1)::int as level, pos, p::int as p from b where before is null or p > before")
def parse_answers(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat((F.char_length("text") % 50).cast("string"), F.when(F.col("pos") % 2 == 0, ", Level One, True").otherwise(", Level Two, False"))
    rows = lines_of(table(spark, d, "documents")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("answer"))
    return chunking.parse_answers(rows, "doc_id", "answer")


@query(f"with {LINES}, p as (select doc_id, pos as lft, lead(pos) over (partition by doc_id order by pos) as nxt, max_pos from (select *, max(pos) over (partition by doc_id) + 1 as max_pos from lines) where pos % 4 = 0) select doc_id, lft::int as lft, coalesce(nxt, max_pos)::int as rgt from p")
def points_to_clips(spark: SparkSession, d: str) -> DataFrame:
    per = lines_of(table(spark, d, "documents")).groupBy("doc_id").agg(F.collect_list(F.when(F.col("pos") % 4 == 0, F.col("pos"))).alias("p"), (F.max("pos") + 1).alias("n"))
    return per.select("doc_id", F.inline(chunking.points_to_clips(F.col("p"), F.lit(0), F.col("n"))))


@query(f"with {LINES}, c as (select doc_id, pos, text, sum(len({words('text')})) over (partition by doc_id order by pos) as total from lines) select doc_id, pos from c where total <= 120 or pos = 0")
def window_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = lines_of(table(spark, d, "documents")).withColumn("n", fn.word_len(F.col("text")))
    return chunking.window_fill(rows, 120).select("doc_id", "pos")


@query(f"with {LINES}, c as (select doc_id, pos, round(1.2 * sum(len({spaced('text')})) over (partition by doc_id order by pos)) as total from lines), e as (select doc_id, min(case when total >= 100 then pos + 1 end) as e, count(*) as n from c group by doc_id) select doc_id, (case when e is null then n when e > 1 then e - 1 else e end)::int as \"end\" from e")
def paragraph_window(spark: SparkSession, d: str) -> DataFrame:
    return chunking.paragraph_window(lines_of(table(spark, d, "documents")), 100)


@query(f"with {LINES}, g as (select *, (pos // 3)::int as i from lines) select doc_id, i, string_agg(text, chr(10) order by pos) as text from g group by doc_id, i")
def cuts_to_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").withColumn("l", F.split("text", "\n"))
    n = F.size("l")
    cuts = F.transform(F.sequence(F.lit(1), F.ceil(n / 3).cast("int")), lambda i: F.least(i * 3, n))
    return rows.select("doc_id", F.posexplode(chunking.cuts_to_chunks(F.col("l"), cuts)).alias("i", "text"))


@query("""with v as (select label, vec_id, embedding::double[] as v, lag(embedding::double[]) over (partition by label order by vec_id) as b from embeddings),
f as (select label, vec_id, round(1 - list_inner_product(v, b) / sqrt(list_inner_product(v, v) * list_inner_product(b, b)), 9) as distance from v),
q as (select label, quantile_cont(distance, 0.74) as q from f group by label)
select label, vec_id, distance, sum(case when distance > q then 1 else 0 end) over (partition by label order by vec_id)::int as chunk from f join q using (label)""")
def semantic_breaks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    return chunking.semantic_breaks(rows, key="label").select("label", F.col("pos").alias("vec_id"), "distance", "chunk")


@query(r"select page_id, i::int as i, trim(regexp_replace(s, '<[^>]*>', ' ', 'g')) as text from (select page_id, unnest(string_split(html, '<h1')) as s, unnest(range(0, len(string_split(html, '<h1')))) as i from pages)")
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "<h1")).alias("i", "s"))
    return parts.select("page_id", "i", F.trim(F.regexp_replace("s", "<[^>]*>", " ")).alias("text"))


@query(f"with {LINES}, l as (select doc_id, pos, case when pos % 5 = 2 then '# ' || text else text end as text from lines) select doc_id, pos, sum(case when pos > 0 and starts_with(text, '# ') then 1 else 0 end) over (partition by doc_id order by pos)::int as segment from l")
def heading_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = lines_of(table(spark, d, "documents")).withColumn("text", F.when(F.col("pos") % 5 == 2, F.concat(F.lit("# "), "text")).otherwise(F.col("text")))
    return chunking.heading_segments(rows).select("doc_id", "pos", "segment")


@query(f"with {LINES}, h as (select repeat('#', (pos % 4)::int) || ' ' || text as l from lines) select length(replace(regexp_extract(l, '^[ #]*'), ' ', ''))::int as level, count(*) as n from h where length(replace(regexp_extract(l, '^[ #]*'), ' ', '')) > 0 group by 1")
def heading_histogram(spark: SparkSession, d: str) -> DataFrame:
    from lodestack.sources.corpora import heading_histogram as histogram

    marked = lines_of(table(spark, d, "documents")).select(F.concat(F.repeat(F.lit("#"), F.col("pos") % 4), F.lit(" "), F.col("text")).alias("text"))
    return histogram(marked)


BORDERS = "truth as (select doc_id, pos as p, 1 + pos % 3 as level from lines where pos % 2 = 0), found as (select doc_id, pos as p, 1 + (pos // 2) % 3 as level from lines where pos % 3 = 0)"


@query(f"""with {LINES}, {BORDERS}, c as (select level, sum(a) as n_truth, sum(b) as n_found, sum(c) as n_both from (
  select level, 1 as a, 0 as b, 0 as c from truth union all select level, 0, 1, 0 from found union all select level, 0, 0, 1 from truth join found using (doc_id, p, level)) group by level)
select level::int as level, n_truth::bigint as n_truth, n_found::bigint as n_found, n_both::bigint as n_both, n_both / (n_found + 1e-20) as precision, n_both / (n_truth + 1e-20) as recall,
  2 * (n_both / (n_found + 1e-20)) * (n_both / (n_truth + 1e-20)) / (n_both / (n_found + 1e-20) + n_both / (n_truth + 1e-20) + 1e-20) as f1 from c""")
def boundary_prf(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(table(spark, d, "documents")).withColumnRenamed("pos", "p")
    truth = lines.where("p % 2 = 0").select("doc_id", "p", (1 + F.col("p") % 3).alias("level"))
    found = lines.where("p % 3 = 0").select("doc_id", "p", (1 + F.floor(F.col("p") / 2) % 3).cast("int").alias("level"))
    return evaluation.precision_recall_f1(evaluation.boundary_counts(truth, found))


# --- retrieval


@query("""with s as (select q.vec_id as qid, p.vec_id as chunk, list_inner_product(q.embedding::double[], p.embedding::double[]) as score from embeddings q join embeddings p on p.label = q.label where q.vec_id % 20 = 0)
select qid, row_number() over (partition by qid order by score desc, chunk)::int as rank, chunk, score from s qualify rank <= 10""")
def knn_local(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), "label", F.col("embedding").alias("vec"))
    return retrieval.search_local(rows.where("chunk % 20 = 0").withColumnRenamed("chunk", "qid"), rows, 10, "label")


@query("""with s as (select q.vec_id as qid, p.vec_id as chunk, list_inner_product(q.embedding::double[], p.embedding::double[]) as score from embeddings q, embeddings p where q.vec_id % 20 = 0)
select qid, row_number() over (partition by qid order by round(score, 9) desc, chunk)::int as rank, chunk, round(score, 9) as score from s qualify rank <= 10""")
def knn_global(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("vec"))
    return retrieval.search_global(rows.where("chunk % 20 = 0").withColumnRenamed("chunk", "qid"), rows, 10, digits=9)


@query()
def knn_approximate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("vec"))
    return retrieval.search_approximate(rows.where("chunk % 20 = 0").withColumnRenamed("chunk", "qid"), rows, 10)


@query()
def embed_search(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as questions against fixed chunks, embedded with the hashing encoder."""
    chunks = chunking.fixed_chunks(table(spark, d, "documents")).withColumn("chunk", F.xxhash64("chunk_id"))
    passages = retrieval.embed(chunks.withColumn("text", retrieval.passage_text(F.lit(None).cast("string"), F.col("text"), lower=True)))
    questions = retrieval.embed(table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.lower("text").alias("text")))
    found = retrieval.search_global(questions, passages, 8)
    return found.join(chunks.select("chunk", "chunk_id"), "chunk").select("qid", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("""with n as (select vec_id, row_number() over (order by vec_id) - 1 as i, count(*) over () as n from embeddings) select vec_id, least(i // (n // 7), 6)::int as shard from n""")
def shard_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id")
    total = rows.count()
    return retrieval.ordinals(rows, "vec_id").select("vec_id", retrieval.shard_ids(F.col("ordinal"), F.lit(total), 7).alias("shard"))


@query("select user_id, event_type, min(event_id) as event_id from events group by user_id, event_type")
def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return retrieval.first_occurrences(rows, ["user_id", "event_type"], ["event_id"])


@query("select doc_id as index, lang as input, doc_id::varchar as _id, list_value(doc_id || '_0', doc_id || '_1') as retrieved_ids from documents")
def merge_outputs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.col("lang").alias("input"), F.col("doc_id").cast("string").alias("_id"))
    ids = F.array(F.concat("_id", F.lit("_0")), F.concat("_id", F.lit("_1")))
    return retrieval.merge_results(docs, docs.select("index", "input", F.col("_id").alias("id"), ids.alias("retrieved_ids")))


@query("select doc_id as index, case when doc_id % 3 = 0 then source end as pred, doc_id % 3 <> 0 or source is null as todo from documents")
def resume_history(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.col("source").alias("pred"))
    return retrieval.resume(docs.select("index"), docs.where("index % 3 = 0"))


@query("select key, v from (select doc_id as key, lang as v, 0 as l from documents union all select doc_id, source, 1 from documents where doc_id % 2 = 0) qualify row_number() over (partition by key order by l desc) = 1")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    old, new = docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("v")), docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), F.col("source").alias("v"))
    return retrieval.last_wins(old, new, key="key")


@query("select conv_id, len(list(turn)) as n, string_agg(text, '|' order by turn) as questions from conversations group by conv_id")
def qa_by_doc(spark: SparkSession, d: str) -> DataFrame:
    from lodestack.sources.readers import questions_by_document

    qas = table(spark, d, "conversations").select(F.col("conv_id").alias("_id"), F.col("turn").alias("index"), F.col("text").alias("input"), F.array().cast("array<string>").alias("answers"))
    grouped = questions_by_document(qas)
    return grouped.select(F.col("_id").alias("conv_id"), F.size("questions").cast("long").alias("n"), F.array_join(F.transform("questions", lambda q: q["input"]), "|").alias("questions"))


# --- context


RANKED = f"with recursive {CHUNKS}, ranked as (select source as qid, row_number() over (partition by source order by doc_id, ordinal) as rank, doc_id || '_' || ordinal as chunk_id, c.text from chunks c join documents using (doc_id))"


@query(f"""{RANKED}, k as (select *, len({spaced('text')}) as n from ranked), b as (select *, coalesce(sum(n) over (partition by qid order by rank rows between unbounded preceding and 1 preceding), 0) as before from k),
c as (select qid, string_agg(text, chr(10) || chr(10) order by rank) as t, sum(n) as total, count(*) as m from b where before < 500 group by qid)
select qid, case when total > 500 then array_to_string({spaced('t')}[1:500], ' ') else t end as context, m::int as n_chunks from c""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    chunks = chunking.fixed_chunks(docs).join(docs.select("doc_id", "source"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id", "ordinal"))
    return context.budget_context(chunks.select(F.col("source").alias("qid"), rank.alias("rank"), "chunk_id", "text"), 500)


@query("""select o_orderkey, c >= p / 3 * (1 + t / 4096) and s >= 2 and 3 * s - s <= 4096 - t as merges from (select o_orderkey, o_totalprice as c, o_totalprice * 2.5 as p, (o_orderkey % 4000)::double as t, (o_orderkey % 5)::int as s from orders)""")
def merge_condition(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    price, siblings = F.col("o_totalprice"), (F.col("o_orderkey") % 5).cast("int")
    test = context.merge_test(price, siblings, price * 2.5, 3 * siblings, siblings, (F.col("o_orderkey") % 4000).cast("double"), F.lit(4096))
    return o.select("o_orderkey", test.alias("merges"))


@query()
def auto_merge(spark: SparkSession, d: str) -> DataFrame:
    """Every third leaf of each document as a ranked result, merged into parents within 300 words."""
    splits = splits_of(table(spark, d, "documents")).where(~fn.is_blank(F.col("text")))
    chunks = materialize(chunking.leaf_chunks(splits), "leaves")  # read three times
    nodes = chunking.leaf_nodes(chunking.tree_nodes(splits), chunks)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("ordinal") % 3, "ordinal"))
    ranked = chunks.select(F.col("doc_id").alias("qid"), rank.alias("rank"), "doc_id", "ordinal")
    return context.auto_merge_contexts(ranked, chunks, nodes, 300)


# --- evaluation


@query(f"with {PAIRS}, t as (select conv_id, turn, list_filter(string_split({norm('pred')}, ' '), lambda w: w <> '') as a, list_filter(string_split({norm('truth')}, ' '), lambda w: w <> '') as b from pairs), c as (select *, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))) as o from t) select conv_id, turn, round(case when o > 0 then 2.0 * (o / len(a)) * (o / len(b)) / (o / len(a) + o / len(b)) else 0 end, 9) as f1 from c")
def qa_f1(spark: SparkSession, d: str) -> DataFrame:
    return pairs_of(spark, d).select("conv_id", "turn", F.round(metrics.qa_f1(F.col("pred"), F.col("truth")), 9).alias("f1"))


@query()
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return pairs_of(spark, d).select("conv_id", "turn", F.round(metrics.rouge_l("pred", "truth"), 9).alias("f"))


@query(f"""with {PAIRS}, t as (select conv_id, turn, {spaced('pred')} as a, {spaced('truth')} as b from pairs),
g as (select conv_id, turn, n, 1 as ca, 0 as cb, unnest(list_transform(range(1, len(a) - n + 2), lambda i: array_to_string(a[i:i + n - 1], chr(1)))) as gram from t, (select unnest([1, 2, 3, 4]) as n)
  union all select conv_id, turn, n, 0, 1, unnest(list_transform(range(1, len(b) - n + 2), lambda i: array_to_string(b[i:i + n - 1], chr(1)))) from t, (select unnest([1, 2, 3, 4]) as n)),
k as (select conv_id, turn, n, gram, sum(ca) as ca, sum(cb) as cb from g group by all),
p as (select conv_id, turn, n, sum(least(ca, cb)) as hits, sum(ca) as total from k group by all),
l as (select conv_id, turn, sum(case when hits > 0 then ln(hits / total) / 4 end) as logs, count(*) filter (hits > 0) as orders from p group by all)
select conv_id, turn, round(case when orders = 4 then exp(logs + case when len(a) >= len(b) then 0 else 1 - len(b) / len(a) end) else 0 end, 9) as bleu from t left join l using (conv_id, turn)""")
def bleu(spark: SparkSession, d: str) -> DataFrame:
    return pairs_of(spark, d).select("conv_id", "turn", F.round(metrics.bleu(fn.split_space(F.col("pred")), fn.split_space(F.col("truth"))), 9).alias("bleu"))


HIT = f"select item_id, doc_id, source, b.text as evidence, length(b.text) as n, contains({norm('d.text')}, {norm('b.text')}) as hit from benchmark b, documents d"


@query(f"select item_id, doc_id from ({HIT}) where hit")
def evidence_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The evidences that stand in each document."""
    return joins.contained(table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text"))


@query(f"""with recursive {CHUNKS}, c as (select doc_id, {norm('c.text')} as t from chunks c), b as (select item_id, {norm('text')} as e, length(text) as n from benchmark),
whole as (select item_id, doc_id from b, documents d where contains({norm('d.text')}, e)),
h as (select w.item_id, w.doc_id, b.n, max(case when contains(c.t, b.e) then 1.0 else 0.0 end) as hit from whole w join b using (item_id) join c using (doc_id) group by all)
select source, round(sum(hit * n) / (sum(n) + 1e-20), 9) as recall, count(*) as n_evidences from h join documents using (doc_id) group by source""")
def evidence_survival(spark: SparkSession, d: str) -> DataFrame:
    """How much of the evidence that a document holds stands whole in one of its fixed-size chunks, by source."""
    held = materialize(evidence_pairs(spark, d), "held")
    items = table(spark, d, "benchmark").select("item_id", F.char_length("text").alias("n"), fn.normalize_answer(F.col("text")).alias("e"))
    docs = table(spark, d, "documents")
    chunks = chunking.fixed_chunks(docs.join(held.select("doc_id").distinct(), "doc_id", "left_semi")).select("doc_id", fn.normalize_answer(F.col("text")).alias("c"))
    hit = F.max(F.contains("c", "e").cast("double"))
    hits = held.join(items, "item_id").join(chunks, "doc_id").groupBy("item_id", "doc_id", "n").agg(hit.alias("hit"))
    rows = hits.join(docs.select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.round(F.sum(F.col("hit") * F.col("n")) / (F.sum("n") + evaluation.TINY), 9).alias("recall"), F.count(F.lit(1)).alias("n_evidences"))


@query(f"""with {PAIRS}, s as (select conv_id, turn, turn % 3 as a, case when length(pred) > 0 then least(1.0, length(truth) / length(pred)) else 0 end as v from pairs), m as (select conv_id, a, avg(v) as m from s group by all), b as (select conv_id, greatest(max(m), 0) as b from m group by conv_id)
select (conv_id % 5)::int as dataset, round(100 * sum(b) / (count(*) + 1e-20), 2) as score, count(*) as n from b group by 1""")
def dataset_scores(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.char_length("pred") > 0, F.least(F.lit(1.0), F.char_length("truth") / F.char_length("pred"))).otherwise(0.0)
    rows = pairs_of(spark, d).withColumn("dataset", (F.col("conv_id") % 5).cast("int")).withColumn("answer_idx", F.col("turn") % 3)
    return evaluation.dataset_scores(rows, ["dataset"], "conv_id", score)


@query()
def dataset_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Conversations dealt over all data sets: each one's score by its own metric, and how much of the next turn a part of it holds."""
    names = F.array(*map(F.lit, sorted(metrics.METRIC_OF)))
    rows = pairs_of(spark, d).withColumn("dataset", F.get(names, F.pmod(F.col("conv_id"), F.size(names)).cast("int"))).withColumn("answer_idx", F.col("turn") % 3)
    scored = rows.withColumn("score", metrics.by_metric(metrics.metric_of(F.col("dataset")), fn.strip_answer_mark(F.col("pred")), F.col("truth")))
    scores = evaluation.dataset_scores(scored, ["dataset"], "conv_id", F.col("score"))
    held = rows.select("dataset", fn.sentences_en(F.col("truth")).alias("evidences"), F.array("truth").alias("answers"), F.concat("pred", F.lit("\n"), F.left("truth", F.lit(200))).alias("context"))
    return scores.join(evaluation.retrieval_scores(held, "dataset", "evidences", "answers", "context"), "dataset")


@query("select doc_id, coalesce(nullif((doc_id % 2)::double, 0), nullif((doc_id % 3)::double, 0)) as score from documents")
def ret_score_fallback(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", evaluation.retrieval_score((i % 2).cast("double"), (i % 3).cast("double")).alias("score"))


@query("select doc_id from documents left join labels l using (doc_id) where l.doc_id is null or toxic = 1")
def class_filter(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"))).alias("all_classes"))
    return evaluation.class_filter(table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left"), "toxic").select("doc_id")


@query("""with r as (select l_orderkey as item, l_linenumber % 2 as response, avg(case when l_returnflag = 'R' then 1 else 0 end) as rate, count(*) as n from lineitem group by all),
p as (select item, avg(rate) as r, max(n) as n, stddev_pop(rate) as d from r group by item)
select round(100 * sum(r * n) / (sum(n) + 1e-20), 6) as recall, round(avg(d), 6) as spread from p""")
def fact_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_linenumber") % 2).alias("response"), (F.col("l_returnflag") == "R").cast("int").alias("attributed"))
    return evaluation.micro_recall(evaluation.fact_recall(rows, "item"), "item").select(F.round("recall", 6).alias("recall"), F.round("spread", 6).alias("spread"))


@query("select doc_id, qid from (select d.doc_id, c.conv_id as qid from documents d join (select distinct conv_id from conversations) c on c.conv_id = d.doc_id)")
def semi_join_datasets(spark: SparkSession, d: str) -> DataFrame:
    talks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id").join(talks, "doc_id", "left_semi").select("doc_id", F.col("doc_id").alias("qid"))


def marked_lines(docs: DataFrame) -> DataFrame:
    """Lines with headings of level one and two by position."""
    return lines_of(docs).withColumn("text", F.when(F.col("pos") % 6 == 0, F.concat(F.lit("# "), "text")).when(F.col("pos") % 3 == 0, F.concat(F.lit("## "), "text")).otherwise(F.col("text")))


@query()
def training_samples(spark: SparkSession, d: str) -> DataFrame:
    from lodestack.operators.training import training_samples as samples

    return samples(marked_lines(table(spark, d, "documents")), window=400)


@query()
def training_variants(spark: SparkSession, d: str) -> DataFrame:
    from lodestack.operators.training import training_variants as variants

    return variants(marked_lines(table(spark, d, "documents")), [1], window=400)


@query()
def model_chunks(spark: SparkSession, d: str) -> DataFrame:
    from lodestack.operators.deciders import model_chunks as chunks

    return chunks(table(spark, d, "documents"), window=300)


@query()
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    from lodestack.operators.deciders import paragraph_chunks as chunks

    return chunks(table(spark, d, "documents"), target=100)


@query()
def answers(spark: SparkSession, d: str) -> DataFrame:
    """The deterministic answer generator on each turn, with its context the turn before."""
    from lodestack.operators.deciders import generate

    rows = pairs_of(spark, d).select("conv_id", "turn", F.col("pred").alias("context"), F.col("truth").alias("input"))
    return generate(rows, fn.fill_template("{context}\n\nQuestion: {input}\n", context=F.col("context"), input=F.col("input")))


# --- questions, settings, prompts and runs


TURNS = "qas as (select conv_id as _id, turn as index, text as input from conversations)"


def questions_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("_id"), F.col("turn").alias("index"), F.col("text").alias("input"))


@query(f"with {SPLITS}, {TURNS} select _id, index, split_idx, level from qas join splits on doc_id = _id")
def qa_chunks(spark: SparkSession, d: str) -> DataFrame:
    return joins.questions_with(questions_of(spark, d), splits_of(table(spark, d, "documents")).drop("text")).select("_id", "index", "split_idx", "level")


@query(f"with {TURNS} select _id, index, length(text)::int as n_chars from qas join documents on doc_id = _id where text is not null")
def qa_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.char_length("text").alias("n_chars"))
    return joins.questions_with(questions_of(spark, d), docs).select("_id", "index", "n_chars")


@query(f"with {TURNS} select _id, count(*) as n from qas where _id not in (select doc_id from documents where doc_id % 2 = 0) group by _id")
def qa_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return joins.unmatched(questions_of(spark, d), table(spark, d, "documents").where("doc_id % 2 = 0"))


@query(f"""with recursive {CHUNKS}, r as (select doc_id as index, unnest([doc_id || '_0', doc_id || '_2', 'x_1']) as chunk_id, unnest([1, 2, 3]) as rank from documents)
select index, rank::int as rank, chunk_id, text from r join chunks on chunk_id = doc_id || '_' || ordinal""")
def retrieved_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    found = docs.select(F.col("doc_id").alias("index"), F.array(F.concat(key, F.lit("_0")), F.concat(key, F.lit("_2")), F.lit("x_1")).alias("retrieved_ids"))
    return joins.retrieved_chunks(found, chunking.fixed_chunks(docs))


def settings_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("en", "Text: {context} Question: {input}", 60), ("de", "{input} ({context})", 40)], "name string, prompt string, max_length int")


@query(f"""with s as (select * from (values ('en', 'Text: ', ' Question: ', 60), ('de', '', '', 40)) v(name, x, y, most)),
f as (select doc_id, case when lang = 'en' then 'Text: ' || coalesce(text, '') || ' Question: ' || coalesce(source, '') when lang = 'de' then coalesce(source, '') || ' (' || coalesce(text, '') || ')' else coalesce(source, '') || coalesce(text, '') end as p, coalesce(most, 100) as most from documents left join s on name = lang),
w as (select doc_id, p, most, {spaced('p')} as w from f),
c as (select doc_id, case when len(w) > most then array_to_string(w[1:most // 2], ' ') || array_to_string(w[len(w) - most // 2 + 1:], ' ') else p end as prompt from w)
select doc_id, prompt, len({spaced('prompt')})::int as context_length from c""")
def prompt_settings(spark: SparkSession, d: str) -> DataFrame:
    """Prompts by language, cut to the language's length; other languages take the default."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("input"), F.col("text").alias("context"))
    rows = settings.with_settings(docs, settings_of(spark), "lang", default={"prompt": "{input}{context}", "max_length": 100})
    return prompts.prompts(rows).select("doc_id", "prompt", "context_length")


@query(f"""with {TURNS}, m as (select unnest([0, -1]) as budget) select _id, index, budget::int as budget, case when budget = 0 then '' else text end as context, 0 as merge_count from qas cross join m left join documents on doc_id = _id""")
def context_modes(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of the modes without retrieval: none, and the whole document."""
    qas, docs = questions_of(spark, d), table(spark, d, "documents")
    parts = [prompts.contexts(qas, budget, docs=docs).withColumn("budget", F.lit(budget)) for budget in (0, -1)]
    return parts[0].unionByName(parts[1]).select("_id", "index", "budget", "context", "merge_count")


@query("""select lang, round(avg(length(text)), 6) as mean_context_length, sum(doc_id % 4)::bigint as merges, count(*) as n from documents where text is not null group by lang""")
def context_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("lang", F.char_length("text").alias("context_length"), (F.col("doc_id") % 4).alias("merge_count"))
    return evaluation.context_summary(rows, ["lang"]).withColumn("mean_context_length", F.round("mean_context_length", 6))


@query("select round(avg(s), 9) as macro, count(s) as n_datasets from (select source, round(avg(doc_id % 7), 9) as s from documents group by source)")
def macro_average(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "documents").groupBy("source").agg(F.round(F.avg(F.col("doc_id") % 7), 9).alias("score"))
    return evaluation.macro_average(scores).withColumn("macro", F.round("macro", 9))


@query(f"with {LINES}, n as (select doc_id, count(*) as n from lines group by doc_id) select lang, round(avg((doc_id % 10)::double), 9) as mean_time, round(avg(n), 9) as mean_chunks, count(*) as n_docs from n join documents using (doc_id) group by lang")
def chunk_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = docs.where("text is not null").select("lang", "doc_id", (F.col("doc_id") % 10).cast("double").alias("time_cost"), F.size(F.split("text", "\n")).alias("n_splits"))
    found = evaluation.chunk_statistics(rows, ["lang"])
    return found.withColumns({c: F.round(c, 9) for c in ("mean_time", "mean_chunks")})


@query("select l_orderkey, count(*)::int as n, count(*) = count(distinct l_linenumber % 4) as \"unique\" from lineitem group by l_orderkey")
def unique_leaves(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber") % 4).alias("leaves"))
    return joins.unique_leaves(lists, "leaves", "l_orderkey")


@query("select vec_id as chunk, len(embedding)::int as width from embeddings union all select vec_id + 1000000, len(embedding)::int from embeddings")
def bulk_load(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("vec"))
    return retrieval.bulk_load(rows, rows.withColumn("chunk", F.col("chunk") + 1_000_000)).select("chunk", F.size("vec").alias("width"))


@query("select doc_id, lang from documents where lang in ('en', 'fr')")
def allowed_datasets(spark: SparkSession, d: str) -> DataFrame:
    return readers.of_datasets(table(spark, d, "documents").select("doc_id", "lang"), ["en", "fr"], "lang")


@query("select doc_id as index, case when doc_id % 2 = 0 then [source] else [] end as evidences, [] :: varchar[] as facts, [lang] as retrieved_ids from documents where doc_id % 3 = 0")
def resume_refreshed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    history = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("index"), F.array(F.lit("old")).alias("evidences"), F.array(F.lit("old")).alias("retrieved_ids"))
    rows = docs.select(F.col("doc_id").alias("index"), F.when(F.col("doc_id") % 2 == 0, F.array("source")).alias("evidences"), F.array("lang").alias("retrieved_ids"))
    return retrieval.refreshed(history, rows).select("index", "evidences", "facts", "retrieved_ids")


@query(f"""with {LINES}, s as (select doc_id, pos, text, case when pos = 0 then 1 else 1 + pos % 3 end as level from lines)
select doc_id || '.txt' as file, '{{"splits": [' || string_agg('[' || to_json(text || chr(10)) || ', ' || level || ']', ', ' order by pos) || ']}}' as result from s group by doc_id""")
def chunk_results(spark: SparkSession, d: str) -> DataFrame:
    return readers.chunk_results(splits_of(table(spark, d, "documents")))


@query()
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut where the hashing encoder puts neighbouring groups of sentences far apart."""
    return chunking.semantic_chunks(table(spark, d, "documents"), lambda rows: retrieval.embed(rows, "group"))


@query()
def run_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """A whole run: documents of two languages cut into fixed chunks, each question's best eight of its own document."""
    docs = table(spark, d, "documents").where("text is not null").withColumn("dataset", F.col("lang"))
    qas = questions_of(spark, d).join(docs.select(F.col("doc_id").alias("_id"), "dataset"), "_id").withColumn("index", F.xxhash64("_id", "index"))
    done = runs.run_all(runs.Run(top_k=8, datasets=("en", "de")), docs, qas)
    return done.select("index", "_id", F.size("retrieved_ids").alias("n"), "retrieved_ids")


@query(f"""with {PAIRS}, f as (select conv_id, turn, pred, unnest({sents('truth')}) as fact from pairs)
select conv_id, turn, count(*)::int as n_facts, round(avg(case when contains(lower(pred), lower(fact)) then 1.0 else 0.0 end), 9) as recall from f group by conv_id, turn""")
def fact_coverage_run(spark: SparkSession, d: str) -> DataFrame:
    """Facts of each next turn, judged against the turn; every second row brings its facts, the others have them extracted."""
    key = F.struct("conv_id", "turn")
    rows = pairs_of(spark, d).withColumn("index", F.to_json(key))
    facts = F.when(F.col("turn") % 2 == 0, fn.sentences_en(F.col("truth")))
    rows = rows.select("index", "conv_id", "turn", F.lit("").alias("input"), F.array("truth").alias("answers"), F.array("pred").alias("pred"), facts.alias("facts"))
    done = coverage.coverage_run(rows).select("conv_id", "turn", F.col("ref_facts_metrics")[0].alias("m"))
    return done.where(F.size("m.ref_facts") > 0).select("conv_id", "turn", F.size("m.ref_facts").alias("n_facts"), F.round(F.col("m.facts_recall")[0], 9).alias("recall"))


@query(f"""with {NODES}, t as (select doc_id, split_idx, length(text) as n, len({spaced('text')}) as w from splits)
select n.doc_id, n.depth::int as depth, n.lft::int as lft, n.rgt::int as rgt, sum(t.n)::bigint as chars, sum(t.w)::bigint as tokens from nodes n join t on t.doc_id = n.doc_id and t.split_idx >= n.lft and t.split_idx < n.rgt group by all""")
def interval_totals(spark: SparkSession, d: str) -> DataFrame:
    """The characters and words under each node of the hierarchy, with lines as leaves."""
    splits = splits_of(table(spark, d, "documents").where("doc_id is not null"))
    return context.tree_totals(splits).select("doc_id", "depth", "lft", "rgt", "chars", "tokens")


@query("select doc_id, case when doc_id % 3 = 0 then lang end as lang, doc_id % 3 <> 0 as todo from documents")
def cached_results(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return retrieval.cached(docs.select("doc_id"), docs.where("doc_id % 3 = 0").select("doc_id", "lang"), "doc_id", "lang")


@query("select conv_id, turn, 'local' as scope, text as input, [conv_id || '_0', conv_id || '_1'] as retrieved_ids from conversations union all select conv_id, turn, 'global', text, ['x_1'] from conversations")
def retrieval_scopes(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    key = F.col("conv_id").cast("string")
    ctx = lambda *ids: F.array(*[F.struct(i.alias("id"), F.lit("").alias("title"), F.lit("1").alias("score")) for i in ids])
    rows = lambda ctxs: turns.select("conv_id", "turn", F.to_json(F.struct("conv_id", "turn")).alias("index"), F.col("text").alias("question"), key.alias("id"), ctxs.alias("ctxs"))
    parts = [rows(ctx(F.concat(key, F.lit("_0")), F.concat(key, F.lit("_1")))), rows(ctx(F.lit("x_1")))]
    made = [p.select("conv_id", "turn", "index").join(retrieval.retrieval_rows(p), "index") for p in parts]
    return retrieval.by_scope(*made).select("conv_id", "turn", "scope", "input", "retrieved_ids")
