"""Queries: chats, texts, answer grading, descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from exselect.functions import chat, grading, labels, text
from exselect.operators import analytics
from exselect.plans.registry import SCORING_SQL, query, scoring_records, sql_terms
from exselect.sources import readers
from exselect.sources.readers import read_table


def conversations(spark, sf):
    return read_table(spark, sf, "conversations")


RENDER_SQL = """
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last FROM conversations),
piece AS (SELECT conv_id, turn, '<|' || role || '|>' || chr(10) || text ||
  CASE WHEN role = 'assistant' THEN CASE WHEN last THEN '</s>' ELSE '</s>' || chr(10) END ELSE chr(10) END AS piece FROM m),
chats AS (SELECT conv_id, '<s>' || string_agg(piece, '' ORDER BY turn) AS text FROM piece GROUP BY conv_id)"""


@query("render_chat", f"WITH {RENDER_SQL} SELECT conv_id, text FROM chats")
def render_chat(spark, sf):
    return chat.render_chat(conversations(spark, sf), "<s>", "</s>")


@query("render_chat_with_prompt", f"WITH {RENDER_SQL} SELECT conv_id, md5(text || '<|assistant|>' || chr(10)) AS digest FROM chats")
def render_chat_with_prompt(spark, sf):
    chats = chat.render_chat(conversations(spark, sf), "<s>", "</s>", generation_prompt=True)
    return chats.select("conv_id", F.md5("text").alias("digest"))


@query(
    "tokenize_documents",
    f"""SELECT doc_id, len(t)::BIGINT AS terms, t[1] AS first_term, t[len(t)] AS last_term
FROM (SELECT doc_id, {sql_terms('text')}[1:4096] AS t FROM documents)""",
)
def tokenize_documents(spark, sf):
    docs = chat.tokenize(read_table(spark, sf, "documents"))
    return docs.select(
        "doc_id", F.size("terms").cast("bigint").alias("terms"), F.get("terms", F.lit(0)).alias("first_term"),
        F.try_element_at("terms", F.lit(-1)).alias("last_term"),
    )


TURN_SQL = f"""
t AS (SELECT conv_id, turn, role, {sql_terms('text')} AS terms FROM conversations),
tok AS (SELECT conv_id, turn, unnest(list_concat(['<|' || role || '|>'], terms)) AS token,
        unnest(list_concat([false], list_transform(terms, lambda x: role = 'assistant'))) AS keep,
        unnest(range(len(terms) + 1)) AS pos FROM t),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS i FROM tok)"""


@query(
    "assistant_labels_by_offset",
    f"""WITH {TURN_SQL} SELECT conv_id, count(*) AS tokens, sum(keep::BIGINT)::BIGINT AS unmasked,
sum(CASE WHEN keep THEN i ELSE 0 END)::BIGINT AS place_sum FROM num WHERE i <= 4096 GROUP BY conv_id""",
)
def assistant_labels_by_offset(spark, sf):
    return _label_summary(chat.assistant_labels(conversations(spark, sf)))


def _label_summary(masked):
    places = F.filter(
        F.transform("unmasked", lambda keep, i: F.when(keep, i + 1)), lambda p: p.isNotNull()
    )
    return masked.select(
        "conv_id", F.size("tokens").cast("bigint").alias("tokens"), F.size(places).cast("bigint").alias("unmasked"),
        F.aggregate(places, F.lit(0).cast("bigint"), lambda t, x: t + x).alias("place_sum"),
    )


@query(
    "assistant_labels_by_first_match",
    f"""WITH {TURN_SQL},
whole AS (SELECT conv_id, list(token ORDER BY i) AS tokens FROM num WHERE i <= 4096 GROUP BY conv_id),
ans AS (SELECT conv_id, turn, terms FROM t WHERE role = 'assistant' AND len(terms) > 0),
pos AS (SELECT conv_id, turn, len(terms) AS n, min(p) AS p FROM (
          SELECT ans.conv_id, turn, terms, tokens, unnest(range(1, len(tokens) - len(terms) + 2)) AS p FROM ans JOIN whole USING (conv_id))
        WHERE tokens[p:p + len(terms) - 1] = terms GROUP BY ALL),
marked AS (SELECT DISTINCT conv_id, unnest(range(p, p + n)) AS i FROM pos)
SELECT conv_id, max(len(tokens))::BIGINT AS tokens, count(i) AS unmasked, coalesce(sum(i), 0)::BIGINT AS place_sum
FROM whole LEFT JOIN marked USING (conv_id) GROUP BY conv_id""",
)
def assistant_labels_by_first_match(spark, sf):
    return _label_summary(chat.assistant_labels(conversations(spark, sf), mode="first_match"))


@query(
    "chats_with_labels",
    f"WITH {TURN_SQL} SELECT conv_id, count(*) AS tokens FROM num WHERE i <= 4096 GROUP BY conv_id HAVING sum(keep::BIGINT) > 0",
)
def chats_with_labels(spark, sf):
    labelled = chat.with_labels(chat.assistant_labels(conversations(spark, sf)))
    return chat.drop_fully_masked(labelled).select("conv_id", F.size("labels").cast("bigint").alias("tokens"))


@query("batched_map", "SELECT doc_id, length(text)::BIGINT AS chars, upper(lang) AS lang FROM documents")
def batched_map(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")

    def measure(frame):
        return frame.assign(chars=frame["text"].str.len(), lang=frame["lang"].str.upper())[["doc_id", "chars", "lang"]]

    return chat.map_batches(docs, measure, "doc_id bigint, chars bigint, lang string")


@query(
    "exact_conversation_lookup",
    f"WITH {RENDER_SQL} SELECT a.conv_id AS target_id, b.conv_id FROM chats a JOIN chats b ON a.text = b.text",
)
def exact_conversation_lookup(spark, sf):
    """Every chat looked up by its whole text: itself and the chats with the very same messages."""
    chats = chat.render_chat(conversations(spark, sf), "<s>", "</s>")
    targets = chats.select(F.col("conv_id").alias("target_id"), "text")
    return chat.find_conversations(chats, targets)


FENCED = "concat(text, '\n```py\nx = ', n_chars, '\n```\n', lang, '\n````\n\n```` tail')"


@query(
    "text_and_code_segments",
    f"""WITH f AS (SELECT doc_id, {FENCED} AS text, text AS body, n_chars, lang FROM documents),
s AS (SELECT doc_id, unnest([{{'pos': 0, 'segment': body || chr(10), 'is_code': false}},
{{'pos': 1, 'segment': 'x = ' || n_chars::VARCHAR, 'is_code': true}}, {{'pos': 2, 'segment': chr(10) || lang || chr(10), 'is_code': false}},
{{'pos': 3, 'segment': '', 'is_code': true}}, {{'pos': 4, 'segment': ' tail', 'is_code': false}}]) AS x FROM f)
SELECT doc_id, x.pos AS pos, md5(x.segment) AS digest, x.is_code AS is_code FROM s""",
)
def text_and_code_segments(spark, sf):
    """Every document with two fenced blocks put behind it."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.expr(FENCED.replace("\n", "\\n")).alias("text"))
    parts = text.split_text_and_code(docs, "doc_id")
    return parts.select("doc_id", "pos", F.md5("segment").alias("digest"), "is_code")


@query(
    "wide_script_share",
    """SELECT lang, count(*) AS documents, sum(regexp_matches(text || CASE WHEN doc_id % 3 = 0 THEN 'слово' WHEN doc_id % 3 = 1 THEN '漢字' ELSE '' END,
'[\\x{4e00}-\\x{9fff}\\x{0400}-\\x{04ff}]')::BIGINT)::BIGINT AS wide FROM documents GROUP BY lang""",
)
def wide_script_share(spark, sf):
    docs = read_table(spark, sf, "documents").withColumn("text", F.expr(
        "concat(text, CASE doc_id % 3 WHEN 0 THEN 'слово' WHEN 1 THEN '漢字' ELSE '' END)"
    ))
    return docs.groupBy("lang").agg(
        F.count("*").alias("documents"), F.sum(text.has_wide_script("text").cast("bigint")).alias("wide")
    )


MARKED = r"concat('## ', text, '\n\\(a_', doc_id, '\\) and \\[ b \n', lang, ' \\]\n#### four\n# one')"


@query(
    "markup_normalization",
    r"""WITH x AS (SELECT doc_id, '## ' || text || chr(10) || '\(a_' || doc_id::VARCHAR || '\) and \[ b ' || chr(10) || lang || ' \]' || chr(10) || '#### four' || chr(10) || '# one' AS text FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\\((.*?)\\\)', '$\1$', 'gs'), '\\\[\s*(.*?)\s*\\\]', '$\1$', 'gs'), '(?m)^(#{1,3})\s*(.*)$', '\2', 'g')) AS digest FROM x""",
)
def markup_normalization(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", F.expr(MARKED).alias("text"))
    return docs.select("doc_id", F.md5(text.normalize_markup("text")).alias("digest"))


@query(
    "instruction_tags",
    """SELECT item_id, md5(text || ' Let''s write a program.') AS tagged, md5(text) AS bare FROM benchmark""",
)
def instruction_tags(spark, sf):
    items = read_table(spark, sf, "benchmark").withColumn("tagged", text.add_instruction_tag("text", "pot_prompt"))
    return items.select(
        "item_id", F.md5("tagged").alias("tagged"), F.md5(text.remove_instruction_tag("tagged", "pot_prompt")).alias("bare")
    )


@query(
    "answer_choices",
    """SELECT p_partkey, concat_ws('|', p_name, p_brand, p_type, p_size, CASE WHEN p_size % 2 = 1 THEN 'none' END) AS options FROM part""",
)
def answer_choices(spark, sf):
    """Questions built from parts, with and without a fifth choice."""
    question = F.expr(
        "concat('Which? Answer Choices: (A) ', p_name, ' (B) ', p_brand, ' (C) ', p_type, ' (D) ', p_size, "
        "CASE WHEN p_size % 2 = 1 THEN ' (E) none' ELSE '' END, ' Let\\'s think.')"
    )
    parts = read_table(spark, sf, "part")
    return parts.select("p_partkey", F.array_join(text.recover_options(question), "|").alias("options"))


# --- grading -----------------------------------------------------------------------------------------

@query(
    "numbers_in_documents",
    """SELECT doc_id, len(n)::BIGINT AS numbers, round(list_sum(n) / 1e6, 6) AS total FROM (
SELECT doc_id, list_filter(list_transform(list_filter(regexp_extract_all(replace(text, ',', ''), '[+-]? *(?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:[eE][+-]?\\d+)?'),
lambda x: NOT regexp_matches(x, '^[+-] *0+[1-9]\\d*$')), lambda x: TRY_CAST(replace(regexp_replace(x, '^[ 0]+', ''), ' ', '') AS DOUBLE)),
lambda x: x IS NOT NULL) AS n FROM documents)""",
)
def numbers_in_documents(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", grading.extract_nums("text").alias("n"))
    return docs.select(
        "doc_id", F.size("n").cast("bigint").alias("numbers"),
        F.when(F.size("n") > 0, F.round(F.aggregate("n", F.lit(0.0), lambda t, x: t + x) / 1e6, 6)).alias("total"),
    )


@query(
    "formulas_and_hash_answers",
    """SELECT event_id, 'k' || '=' || user_id::VARCHAR AS formula, replace(printf('%,d', event_id * 1000), ',', '') AS answer,
regexp_replace(regexp_replace(value::DECIMAL(18,2)::VARCHAR, '0+$', ''), '\\.$', '') AS plain FROM events""",
)
def formulas_and_hash_answers(spark, sf):
    events = read_table(spark, sf, "events").withColumn("response", F.expr(
        "concat('so <<k=', user_id, '>> holds\\n#### ', format_number(event_id * 1000, 0))"
    ))
    return events.select(
        "event_id", grading.find_formula("response").alias("formula"), grading.extract_answer("response").alias("answer"),
        grading.delete_extra_zero(F.format_string("%.2f", "value")).alias("plain"),
    )


LATEX = """CASE event_id % 6 WHEN 0 THEN concat('\\\\dfrac', user_id % 9 + 1, '{', user_id, '}') WHEN 1 THEN concat(user_id, '/', event_id)
WHEN 2 THEN concat('x = .', user_id, '\\\\%') WHEN 3 THEN concat('\\\\sqrt', user_id % 9, ' \\\\text{ cm}')
WHEN 4 THEN concat('\\\\left( ', user_id, '^\\\\circ \\\\right)') ELSE concat('\\\\frac', user_id % 9, event_id % 9) END"""


@query(
    "latex_answers",
    r"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('\frac{', user_id % 9 + 1, '}{', user_id, '}') WHEN 1 THEN concat('\frac{', user_id, '}{', event_id, '}')
WHEN 2 THEN concat('0.', user_id) WHEN 3 THEN concat('\sqrt{', user_id % 9, '}') WHEN 4 THEN concat('(', user_id, ')')
ELSE concat('\frac{', user_id % 9, '}{', event_id % 9, '}') END AS clean FROM events""",
)
def latex_answers(spark, sf):
    events = read_table(spark, sf, "events").withColumn("latex", F.expr(LATEX))
    return events.select("event_id", grading.strip_latex("latex").alias("clean"))


MATH_TEXT = """CASE event_id % 4 WHEN 0 THEN concat('Thus. The answer is ', user_id, '.')
WHEN 1 THEN concat('so \\\\boxed{\\\\frac{', user_id, '}{', event_id, '}} done') WHEN 2 THEN concat('so \\\\boxed ', user_id, '$ ok')
ELSE concat('first ', event_id, ' then -', user_id, ' apples') END"""


@query(
    "math_answers",
    r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN concat('\frac{', user_id, '}{', event_id, '}')
WHEN 2 THEN user_id::VARCHAR ELSE concat('-', user_id) END AS answer FROM events""",
)
def math_answers(spark, sf):
    events = read_table(spark, sf, "events").withColumn("response", F.expr(MATH_TEXT))
    return events.select("event_id", grading.answer_clean(F.lit("math"), ["The answer is"], "response").alias("answer"))


RESPONSE = """CASE event_id % 4 WHEN 0 THEN concat('We get 7 first. The answer is ', format_number(user_id * 100, 0), '.00 and 5 more')
WHEN 1 THEN concat('sum = ', user_id, '.50') WHEN 2 THEN 'The answer is (c) not d' ELSE 'B or maybe E' END"""
DATASET = "CASE event_id % 4 WHEN 0 THEN 'gsm8k' WHEN 1 THEN 'svamp' WHEN 2 THEN 'aqua' ELSE 'numglue' END"


@query(
    "answer_grading",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN (user_id * 100)::VARCHAR WHEN 1 THEN user_id::VARCHAR || '.5' WHEN 2 THEN 'C' ELSE 'E' END AS answer,
CASE event_id % 4 WHEN 0 THEN user_id > 0 OR user_id = 0 WHEN 1 THEN user_id + 0.5 BETWEEN value - abs(value) * 0.04 AND value + abs(value) * 0.04
  AND value <> floor(value) OR value = floor(value) AND round_even(user_id + 0.5, 0) = value WHEN 2 THEN true ELSE false END AS correct FROM events""",
)
def answer_grading(spark, sf):
    """Extract the answer of each response by its corpus, then grade it against text or number."""
    events = read_table(spark, sf, "events").select(
        "event_id", "user_id", "value", F.expr(RESPONSE).alias("response"), F.expr(DATASET).alias("dataset")
    )
    answered = events.withColumn("answer", grading.answer_clean("dataset", ["The answer is"], "response"))
    gold_text = F.expr("CASE event_id % 4 WHEN 2 THEN 'C' ELSE 'none' END")
    gold_number = F.expr("CASE event_id % 4 WHEN 0 THEN user_id * 100.0D WHEN 1 THEN value END")
    return answered.select("event_id", "answer", grading.grade("answer", gold_text, gold_number).alias("correct"))


@query(
    "number_texts",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id / (event_id + 1) WHEN 1 THEN user_id * 1000.0 ELSE NULL END AS number,
CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN (user_id * 1000)::DOUBLE END AS plain FROM events""",
)
def number_texts(spark, sf):
    events = read_table(spark, sf, "events").withColumn("x", F.expr(
        "CASE event_id % 3 WHEN 0 THEN concat('\\\\frac{', user_id, '}{', event_id + 1, '}') "
        "WHEN 1 THEN format_number(user_id * 1000, 0) ELSE 'none' END"
    ))
    return events.select(
        "event_id", grading.number_it("x").alias("number"), grading.floatify(F.replace(F.col("x"), F.lit(","), F.lit(""))).alias("plain")
    )


@query(
    "corpus_normalization",
    """SELECT 'gsm8k' AS corpus, count(*) AS n, round(avg(len(string_split(trim(text), ' '))), 7) AS mean_words, sum(item_id * 2)::BIGINT AS answers FROM benchmark
UNION ALL SELECT 'mmlu_biology', count(*), round(avg(len(string_split(p_name || chr(10) || 'Answer Choices: (A) ' || p_brand || ' (B) ' || p_type || ' (C) x (D) y', ' '))), 7), sum(p_size % 4)::BIGINT FROM part""",
)
def corpus_normalization(spark, sf):
    """Two raw layouts built from tables, normalised and summarised."""
    grade_school = read_table(spark, sf, "benchmark").select(
        F.col("text").alias("question"),
        F.concat(F.lit("thus\n#### "), F.format_number(F.col("item_id") * 2, 0), F.lit(".00")).alias("answer"),
    )
    choice = read_table(spark, sf, "part").select(
        F.col("p_name").alias("question"), F.array("p_brand", "p_type", F.lit("x"), F.lit("y")).alias("choices"),
        (F.col("p_size") % 4).alias("answer"),
    )
    corpora = readers.normalize_corpus(grade_school, "gsm8k").unionByName(readers.normalize_corpus(choice, "mmlu_biology"))
    value = F.coalesce(F.col("answer").try_cast("bigint"), F.ascii("answer") - 65)
    return readers.corpus_summary(corpora).join(
        corpora.groupBy("corpus").agg(F.sum(value).cast("bigint").alias("answers")), "corpus"
    ).withColumn("mean_words", F.round("mean_words", 7))


# --- descriptions --------------------------------------------------------------------------------------

@query(
    "description_labels",
    f"""WITH {SCORING_SQL}, k AS (SELECT DISTINCT explanation_type AS x, model, estimator, linear_coder,
CASE WHEN explanation_type LIKE '%sanity%' THEN 1 ELSE regexp_extract(explanation_type, '^(?:Top-)?([0-9]+)', 1)::INTEGER END AS k FROM scoring),
f AS (SELECT *, CASE WHEN x LIKE 'Top-%' AND x LIKE '%facility%' THEN x[5:] WHEN x LIKE '%AIDE%' THEN x[1:-2] || ' most influential (scores with largest absolute value).' ELSE x END AS fixed FROM k)
SELECT x, model, estimator, linear_coder, k,
CASE WHEN model LIKE 'OLMo%' THEN 'Olmo2-1B' WHEN model LIKE 'Qwen%' THEN 'Qwen2.5-0.5B' ELSE 'Llama-3.2-1B' END AS model_name,
split_part(estimator, ':', 1) AS estimator_name, replace(linear_coder, 'Coder', '') AS coder_name,
TRY_CAST(regexp_extract(x, 'seed ([0-9]+)', 1) AS INTEGER) AS seed,
regexp_replace(x, '\\b' || k::VARCHAR || '\\b', 'X') AS no_k, replace(x, k::VARCHAR, 'X') AS no_digits, fixed,
CASE WHEN fixed LIKE '%largest absolute%' THEN 'scores with largest absolute value' WHEN fixed LIKE '%positive%' THEN 'most positive scores'
 WHEN fixed LIKE '%negative%' THEN 'most negative scores' WHEN fixed LIKE '%zero%' THEN 'scores closest to zero' ELSE '-' END AS sort_type,
TRY_CAST(regexp_extract(x, 'lambda=([0-9.]+)', 1) AS DOUBLE) AS lam,
CASE WHEN x LIKE '%DIVINE%' THEN 42 WHEN x LIKE '%AIDE%' THEN 111 ELSE TRY_CAST(regexp_extract(x, 'lambda=([0-9.]+)', 1) AS DOUBLE) END AS lam_code,
regexp_replace(x, 'lambda=[0-9.]+', 'lambda=X') AS no_lambda,
CASE WHEN x LIKE '%facility%' THEN regexp_extract(x, 'lambda=(.*)', 1) WHEN x LIKE '%DIVINE%' OR x LIKE '%AIDE%' THEN 'Other' ELSE 'Naive' END AS category,
CASE WHEN x LIKE '%facility%' THEN 'FL' ELSE 'N' END AS flag
FROM f""",
)
def description_labels(spark, sf):
    x = F.col("x")
    rows = scoring_records(spark, sf).select(F.col("explanation_type").alias("x"), "model", "estimator", "linear_coder").distinct()
    rows = rows.withColumn("k", labels.extract_k(x)).withColumn("fixed", labels.facility_location_hotfix(x, with_aide=True))
    return rows.select(
        "x", "model", "estimator", "linear_coder", "k", labels.rename_model("model").alias("model_name"),
        labels.rename_estimator("estimator").alias("estimator_name"),
        labels.rename_linear_coder("linear_coder").alias("coder_name"), labels.extract_seed(x).alias("seed"),
        labels.replace_k(x, "k").alias("no_k"), labels.replace_k_everywhere(x, "k").alias("no_digits"), "fixed",
        labels.get_sort_type("fixed").alias("sort_type"), labels.get_lambda(x).alias("lam"),
        labels.get_lambda(x, method_codes=True).alias("lam_code"), labels.remove_lambda(x).alias("no_lambda"),
        labels.categorize(x).alias("category"), labels.facility_flag(x).alias("flag"),
    )


@query(
    "short_setting_labels",
    f"""WITH {SCORING_SQL}, d AS (SELECT explanation_type AS x, count(*) AS n, regexp_extract(explanation_type, '^(?:Top-)?([0-9]+)', 1) AS k,
replace(regexp_extract(explanation_type, '(least|most) (influential|helpful|harmful)', 0), 'influential', 'inf.') AS words,
regexp_extract(explanation_type, 'lambda=([0-9.]+)', 1) AS lam FROM scoring GROUP BY explanation_type),
l AS (SELECT *, CASE lam WHEN '0.0' THEN '0' WHEN '1.0' THEN '1' ELSE lam[2:] END AS short FROM d)
SELECT x, n, CASE WHEN x LIKE '%sanity%' THEN 'Test instance' WHEN x LIKE '%random%' THEN k || ' rand'
WHEN x LIKE '%facility%' THEN k || ' by FL ' || words || ' $\\lambda=' || short || '$' WHEN x LIKE '%DIVINE%' THEN k || ' by DIVINE ' || words
WHEN x LIKE '%AIDE%' THEN k || ' by AIDE' ELSE k || ' ' || words END AS label,
CASE WHEN x LIKE '%sanity%' THEN 'Test instance' WHEN x LIKE '%random%' THEN 'random'
WHEN x LIKE '%facility%' THEN ' FL ' || words || ' $\\lambda=' || short || '$' WHEN x LIKE '%DIVINE%' THEN ' DIVINE ' || words
WHEN x LIKE '%AIDE%' THEN ' AIDE' ELSE words END AS pooled FROM l""",
)
def short_setting_labels(spark, sf):
    rows = scoring_records(spark, sf).groupBy(F.col("explanation_type").alias("x")).agg(F.count("*").alias("n"))
    return rows.select(
        "x", "n", labels.rename_explanation_type("x").alias("label"),
        labels.rename_explanation_type(labels.rename_random("x"), False).alias("pooled"),
    )


@query(
    "task_names",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'MMLU-Pro' WHEN 1 THEN 'MMLU' WHEN 2 THEN 'ARC\\_E' ELSE p_type || ' TODO' END AS task FROM part""",
)
def task_names(spark, sf):
    alias = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('mmlu_pro:', p_type) WHEN 1 THEN concat('x_mmlu_', p_size) "
                   "WHEN 2 THEN 'arc_easy::suite' ELSE p_type END")
    return read_table(spark, sf, "part").select("p_partkey", labels.rename_task(alias).alias("task"))


@query(
    "starred_correlations",
    """SELECT l_linenumber, l_returnflag, printf('%.2f', r) || CASE WHEN r < 0.001 THEN '***' WHEN r < 0.01 THEN '**' WHEN r < 0.05 THEN '*' ELSE '' END AS text
FROM (SELECT l_linenumber, l_returnflag, avg(l_tax) * l_linenumber / 10 + 0.00003 AS r FROM lineitem GROUP BY l_linenumber, l_returnflag)""",
)
def starred_correlations(spark, sf):
    rows = read_table(spark, sf, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.avg("l_tax").alias("a"))
    r = F.col("a") * F.col("l_linenumber") / 10 + 0.00003
    return rows.select("l_linenumber", "l_returnflag", labels.with_stars(r, r).alias("text"))


@query(
    "case_study_chats",
    """WITH t AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn)[1:2] AS m FROM conversations GROUP BY conv_id)
SELECT label, conv_id, len(m)::BIGINT AS turns, md5(m[1].text) AS first_text FROM (
SELECT label, vec_id AS conv_id FROM embeddings) e JOIN t USING (conv_id)""",
)
def case_study_chats(spark, sf):
    """Selected ids with the first two turns of their chats."""
    chosen = read_table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("train_id"))
    return analytics.selected_chats(chosen, conversations(spark, sf)).select(
        "label", F.col("train_id").alias("conv_id"), F.size("messages").cast("bigint").alias("turns"),
        F.md5(F.get("messages", F.lit(0))["text"]).alias("first_text"),
    )
