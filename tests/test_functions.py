import math

import pyarrow as pa
import pytest
import random

from pyspark.sql import functions as F

from exselect.functions import chat, grading, labels, text


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi there"), (1, 2, "assistant", "yes sir"), (1, 3, "tool", "secret"),
    (1, 4, "user", "again"), (1, 5, "assistant", "yes sir"), (2, 0, "user", "alone"), (3, 0, "assistant", ""),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(TURNS[::-1], "conv_id bigint, turn bigint, role string, text string")


def test_render(turns):
    got = {r["conv_id"]: r["text"] for r in chat.render_chat(turns, "<s>", "</s>").collect()}
    assert got[1] == "<s><|system|>\nbe kind\n<|user|>\nhi there\n<|assistant|>\nyes sir</s>\n<|user|>\nagain\n<|assistant|>\nyes sir</s>"
    assert got[2] == "<s><|user|>\nalone\n"
    prompt = {r["conv_id"]: r["text"] for r in chat.render_chat(turns, generation_prompt=True).collect()}
    assert prompt[2] == "<|user|>\nalone\n<|assistant|>\n"


def test_labels_of_repeated_answers(turns):
    offset = {r["conv_id"]: r for r in chat.assistant_labels(turns).collect()}
    tokens = "<|system|> be kind <|user|> hi there <|assistant|> yes sir <|user|> again <|assistant|> yes sir".split()
    assert offset[1]["tokens"] == tokens
    assert [i for i, keep in enumerate(offset[1]["unmasked"]) if keep] == [7, 8, 12, 13]
    first = {r["conv_id"]: r for r in chat.assistant_labels(turns, "first_match").collect()}
    assert first[1]["tokens"] == tokens
    assert [i for i, keep in enumerate(first[1]["unmasked"]) if keep] == [7, 8]
    assert first[2]["unmasked"] == [False, False]
    cut = {r["conv_id"]: r for r in chat.assistant_labels(turns, "first_match", max_len=8).collect()}
    assert len(cut[1]["tokens"]) == 8 and not any(cut[1]["unmasked"])


def test_fully_masked_rows_go(turns):
    kept = chat.drop_fully_masked(chat.with_labels(chat.assistant_labels(turns))).collect()
    assert [r["conv_id"] for r in kept] == [1]
    assert kept[0]["labels"].count(chat.MASKED) == 10


def test_terms_are_never_empty(spark):
    got = apply(spark, chat.terms_of, [" a\t b\n", "", " \n ", "x\u00a0y z"])
    assert got == [["a", "b"], [], [], ["x\u00a0y", "z"]]


def test_lookup_and_batches(spark, turns):
    chats = chat.render_chat(turns)
    target = spark.createDataFrame([(7, "<|user|>\nalone\n"), (8, "other")], "target_id int, text string")
    assert [tuple(r) for r in chat.find_conversations(chats, target).collect()] == [(7, 2)]
    out = chat.map_batches(turns, lambda f: f[["conv_id"]].assign(n=f["text"].str.len()), "conv_id bigint, n bigint")
    assert out.agg(F.sum("n")).first()[0] == sum(len(t[3]) for t in TURNS)


def test_code_segments(spark):
    body = "intro\n```python\nprint(1)\n\nx\n```\nmid `a` ````\n\n````"
    got = apply(spark, text.code_segments, [body, "plain", "", "``` open\nnever closed"])
    assert [tuple(s) for s in got[0]] == [("intro\n", False), ("print(1)\n\nx", True), ("\nmid `a` ", False), ("", True)]
    assert [tuple(s) for s in got[1]] == [("plain", False)] and got[2] == []
    assert [tuple(s) for s in got[3]] == [("``` open\nnever closed", False)]


def test_scripts_and_markup(spark):
    assert apply(spark, text.has_wide_script, ["abc é", "日本", "да", ""]) == [False, True, True, False]
    assert apply(spark, text.wide_lines, ["a\nда\r\n本\n"]) == [2]
    got = apply(spark, text.normalize_markup, ["## Head\nuse \\(x\ny\\) and \\[ z \\]\n#### deep"])
    assert got == ["Head\nuse $x\ny$ and $z$\n# deep"]


def test_tags(spark):
    assert apply(spark, lambda c: text.add_instruction_tag(c, "pot_prompt"), ["q"]) == ["q Let's write a program."]
    assert apply(spark, lambda c: text.remove_instruction_tag(c, "be brief"), ["q be brief x"]) == ["q x"]
    assert apply(spark, lambda c: text.add_instruction_tag(c, ""), ["q"]) == ["q"]


def test_options(spark):
    asked = "Q? Answer Choices: (A) one (B) two (C) three (D) four (E) five Let's go"
    got = apply(spark, text.recover_options, [asked, asked.replace(" (E) five", "")])
    assert got == [["one", "two", "three", "four", "five"], ["one", "two", "three", "four"]]
    assert apply(spark, text.choices_text, [asked]) == ["(A) one (B) two (C) three (D) four (E) five "]


def test_numbers(spark):
    got = apply(spark, grading.extract_nums, ["1,200 and -3.5e2, .5 007 0 -05 + 4", "none"])
    assert got == [[1200.0, -350.0, 0.5, 7.0, 4.0], []]
    assert apply(spark, grading.find_formula, ["a <<1+2=3>> b", "<<a>> <<b>>", "none"]) == ["1+2=3", None, None]
    assert apply(spark, grading.extract_answer, ["so\n#### -1,234.5", "no"]) == ["-1234.5", None]
    assert apply(spark, grading.delete_extra_zero, ["3.0", "2.50", "007", "-0", "3/4", "x"]) == ["3", "2.5", "7", "0", "3/4", "x"]


@pytest.mark.parametrize("raw, clean", [
    ("\\frac12", "\\frac{1}{2}"), ("\\frac1{72}", "\\frac{1}{72}"), ("\\tfrac{a}{b}", "\\frac{a}{b}"),
    ("3/4", "\\frac{3}{4}"), ("a/b", "a/b"), ("x = 5", "5"), ("long = 5", "long=5"), (".5", "0.5"),
    ("\\sqrt3 + \\sqrt{4}", "\\sqrt{3}+\\sqrt{4}"), ("10\\text{ cm}", "10"), ("50\\%", "50"),
    ("\\left( 90^\\circ \\right)", "(90)"), ("\\frac", "\\frac"), ("1\\frac2", "1\\frac2"), ("", ""),
    ("\\frac\\frac12", "\\frac\\frac{1}{2}"), ("{.5}", "{0.5}"),
])
def test_latex(spark, raw, clean):
    assert apply(spark, grading.strip_latex, [raw]) == [clean]


def test_math_answers(spark):
    got = apply(spark, grading.extract_math_answer, [
        "The answer is 12.", "hence \\boxed{\\frac{1}{2}} ok", "\\boxed 7$ x", "took 3 then 4.5", "nothing",
        "so the answer is \\boxed{9}", "boxed",
    ])
    assert got == ["12", "\\frac{1}{2}", "7", "4.5", "", "9", ""]


def test_answer_clean(spark):
    rows = [
        ("aqua", "The answer is (b), not c", "B"), ("aqua", "maybe A or D", "D"), ("sat", "The answer is unknown.", "unknown"),
        ("gsm8k", "first 3. The answer is 1,200.0 of 7", "1200"), ("svamp", "x = 3 + 4", "4"), ("numglue", "The answer is 5.50", "5.5"),
        ("math", "The answer is 3/4", "\\frac{3}{4}"), ("math", "", ""), ("gsm8k", "none", ""), ("other", "1", None),
        ("gsm8k", "The answer is 1. \n\nQ The answer is 2", "1"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, x string, want string")
    got = df.withColumn("got", grading.answer_clean("d", ["The answer is"], "x")).orderBy("i").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_number_comparison(spark):
    assert apply(spark, grading.number_it, ["\\frac{3}{4}", "1,500", "3/8", "abc", "1/0"]) == [0.75, 1500.0, 0.375, None, None]
    rows = [("7.5", "x", 8.0, True), ("6.5", "x", 6.0, True), ("1.03", "x", 1.0, True), ("2.6", "x", 2.5, True),
            ("2.61", "x", 2.5, False), ("C", "C", None, True), ("C", "D", None, False), (None, "D", 1.0, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, t string, n double, want boolean")
    got = df.withColumn("got", grading.grade("a", "t", "n")).orderBy("i").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


DESCRIBED = {
    "Top-10 most helpful (most negative scores)": (10, "10 most helpful", "most helpful", "-", "most negative scores"),
    "10 random examples with seed 42": (10, "10 rand", "rand", "-", "-"),
    "The test instance (as a sanity check)": (1, "Test instance", "Test instance", "-", "-"),
    "10 by facility location from Top-100 most influential (scores with largest absolute value). lambda=0.5":
        (10, "10 by FL most inf. $\\lambda=.5$", " FL most inf. $\\lambda=.5$", 0.5, "scores with largest absolute value"),
    "5 by facility location from Top-100 most harmful (most positive scores). lambda=1.0":
        (5, "5 by FL most harmful $\\lambda=1$", " FL most harmful $\\lambda=1$", 1.0, "most positive scores"),
    "10 by DIVINE from Top-100 least influential (scores closest to zero).":
        (10, "10 by DIVINE least inf.", " DIVINE least inf.", "-", "scores closest to zero"),
    "25 by AIDE from Top-100.": (25, "25 by AIDE", " AIDE", "-", "-"),
    "something else that is quite long indeed": (None, "something else that is quite l...", "something else that is quite l...", "-", "-"),
}


def test_descriptions_are_read_back(spark):
    keys = list(DESCRIBED)
    assert apply(spark, labels.extract_k, keys) == [v[0] for v in DESCRIBED.values()]
    assert apply(spark, labels.rename_explanation_type, keys) == [v[1] for v in DESCRIBED.values()]
    assert apply(spark, lambda c: labels.rename_explanation_type(c, False), keys) == [v[2] for v in DESCRIBED.values()]
    assert [x if x is not None else "-" for x in apply(spark, labels.get_lambda, keys)] == [v[3] for v in DESCRIBED.values()]
    assert apply(spark, labels.get_sort_type, keys) == [v[4] for v in DESCRIBED.values()]


def test_replacements(spark):
    df = spark.createDataFrame([("10 by x from Top-100 or 10", 10), ("no", None)], "x string, k int")
    got = df.select(labels.replace_k("x", "k").alias("a"), labels.replace_k_everywhere("x", "k").alias("b")).collect()
    assert got[0]["a"] == "X by x from Top-100 or 10" and got[0]["b"] == "X by x from Top-X0 or X" and got[1]["a"] == "no"
    fixed = apply(spark, lambda c: labels.facility_location_hotfix(c, True), ["Top-5 by facility location", "5 by AIDE from Top-100.", "x"])
    assert fixed == ["5 by facility location", "5 by AIDE from Top-100 most influential (scores with largest absolute value).", "x"]
    assert apply(spark, labels.categorize, list(DESCRIBED)[:7]) == ["Naive", "Naive", "Naive", "0.5", "1.0", "Other", "Other"]
    assert apply(spark, labels.remove_lambda, ["a lambda = 0.5 b lambda=1"]) == ["a lambda=X b lambda=X"]
    assert apply(spark, labels.rename_random, ["5 random examples with seed 42"]) == ["5 random examples"]
    assert apply(spark, labels.extract_seed, ["with seed 42", "x"]) == [42, None]
    assert apply(spark, labels.rename_model, [*labels.MODELS, "x"]) == [*labels.MODELS.values(), None]
    assert apply(spark, labels.rename_linear_coder, ["MSECoderProjUSimpSparseSoftThresh"]) == ["MSEProjUSimpSparseSoft"]
    assert apply(spark, labels.rename_task, ["x_mmlu_pro", "mmlu:1", "zz"]) == ["MMLU-Pro", "MMLU", "zz TODO"]


def test_small_formats(spark):
    rows = spark.createDataFrame([(0.5, 0.0005), (0.456, 0.04), (-0.1, 0.5), (float("nan"), 0.1)], "r double, p double")
    assert [r[0] for r in rows.select(labels.with_stars("r", "p")).collect()] == ["0.50***", "0.46*", "-0.10", ""]
    assert apply(spark, labels.decibel, [100.0], "double") == [20.0]
    assert apply(spark, labels.nmse, [4.0], "double") == [0.25]
    assert math.isclose(apply(spark, lambda c: labels.nmse(c, 1e-10), [0.0], "double")[0], 1e10)
    assert apply(spark, labels.clean_label, ["gain10At5"]) == ["gainAt"]


def test_first_matches_equal_plain_search():
    rng = random.Random(7)
    for _ in range(400):
        tokens = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        answers = [[rng.choice("abcd") for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(0, 12))]
        want = [False] * len(tokens)
        for answer in answers:
            at = next((k for k in range(len(tokens) - len(answer) + 1) if tokens[k:k + len(answer)] == answer), None)
            if at is not None:
                want[at:at + len(answer)] = [True] * len(answer)
        assert chat.first_matches(tokens, answers).tolist() == want


def test_first_matches_take_linear_time():
    """4,096 equal tokens and 500 answers of up to 500 of them: the steps are those of one pass."""
    class Counted(str):
        looked_up = 0

        def __hash__(self):
            Counted.looked_up += 1
            return super().__hash__()

        __eq__ = str.__eq__

    tokens, answers = [Counted("a")] * 4096, [[Counted("a")] * k + [Counted("b")] * (k % 2) for k in range(1, 501)]
    found = chat.first_matches(tokens, answers)
    assert found[:500].all() and not found[500:].any()
    assert Counted.looked_up <= 4096 + sum(map(len, answers))


def test_batches_are_small_while_they_are_python_objects(spark, monkeypatch):
    """Frames and chats come in pieces; nulls, empty frames and other types pass as before."""
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.repeat(F.lit("é"), F.col("id").cast("int") % 5)).alias("text")).coalesce(1)

    def measure(frame):
        return frame.assign(n=frame["text"].str.len(), size=len(frame))[["size", "id", "n"]]

    got = {r.id: r for r in chat.map_batches(rows, measure, "id bigint, n bigint, size int").collect()}
    assert len(got) == 1000 and all(r.n == (i % 5 if i % 3 else None) for i, r in got.items())
    assert max(r.size for r in got.values()) <= chat.ROWS_PER_STEP
    days = rows.select("id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    assert chat.map_batches(days, lambda f: f, "id bigint, day date").exceptAll(days).isEmpty()
    seen = []
    batch = pa.RecordBatch.from_pydict({"x": list(range(100))})
    seen = [b.num_rows for b in chat.row_slices([batch], chat.CHATS_PER_STEP)]
    assert sum(seen) == 100 and max(seen) <= 32
