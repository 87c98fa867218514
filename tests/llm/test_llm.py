"""Tokens against the public library, sketches against exact ranks, mixtures against their targets, sentences against marked texts."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import quantiles as q
from plumbline.llm.mixing import Node, budgets, mixture, rounded, spread
from plumbline.llm.sentences import BREAK, CUT, MARK, marked, sentences
from plumbline.llm.tokens import Encoder, default_path, token_counts, token_ids

# --- tokens ---


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def coder():
    return Encoder(default_path())


def ours(coder, texts):
    flat, count = coder.encode(texts)
    ends = np.r_[0, np.cumsum(count)]
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


ODD = ["", " ", "\n\n  x", "a" * 400, "aaa aaaa", "<|endoftext|>", "it's I'LL we've", "日本語のテキスト" * 30, "नमस्ते दुनिया", "\x00\x01", "é é ﬁ 𝒳 👩‍👩‍👧", "1234567890" * 9, "\r\n\t   x", "--==--==" * 50]


def test_tokens_equal_library(coder, library):
    assert ours(coder, ODD) == [library.encode(t, add_special_tokens=False).ids for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_tokens_of_any_text(coder, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ours(coder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_of_table(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.ids for r in token_ids(docs).collect()}
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    assert got == want
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()} == {k: len(v) for k, v in want.items()}


def test_tokens_edges(spark, library, monkeypatch):
    from plumbline.llm import tokens

    monkeypatch.setattr(tokens, "SEGMENT", 50)
    t = spark.createDataFrame([(1, None, 7), (1, "", 7), (2, "ab cd", 7), (2, "ab cd", 7)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id, tuple(r.ids)) for r in token_ids(t).collect()) == [(1, ()), (1, ()), (2, tuple(library.encode("ab cd").ids)), (2, tuple(library.encode("ab cd").ids))]
    assert token_ids(t.limit(0)).count() == 0 and token_ids(t).columns == ["doc_id", "ids"]
    long = "word, 12 (x)  y\n" * 3000 + "z" * 5000
    assert ours(Encoder(default_path()), [long]) == [library.encode(long, add_special_tokens=False).ids]


def test_words_are_forgotten(library, monkeypatch):
    from plumbline.llm import tokens

    monkeypatch.setattr(tokens, "WORDS_KEPT", 5)
    c = Encoder(default_path())
    for k in range(4):
        texts = [f"w{k}a w{k}b w{k}c other{k} words{k}", "again"]
        assert ours(c, texts) == [library.encode(t).ids for t in texts]


# --- quantiles ---


def off(values, r, probs, n):
    v = np.sort(values)
    return max(max(0, np.searchsorted(v, getattr(r, f"q_{100 * p:g}")) / n - p, p - np.searchsorted(v, getattr(r, f"q_{100 * p:g}"), "right") / n) for p in probs)


@pytest.mark.parametrize("parts", [1, 6])
def test_sketch_within_bound(spark, parts, monkeypatch):
    monkeypatch.setattr(q, "BLOCK_ITEMS", 3000)
    k, probs = 64, (0.05, 0.5, 0.95)
    rng = np.random.default_rng(parts)
    groups = {"big": rng.lognormal(3, 1, 40_000), "small": rng.normal(size=50), "flat": np.full(900, 4.0), "sorted": np.arange(5000.0), None: np.array([1.0])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("small", float("nan")), ("small", None), ("none", None)]
    t = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    got = {r.g: r for r in q.quantiles(q.sketch(t, ("g",), "v", k), ("g",), probs, k).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g].n == v.size and off(v, got[g], probs, v.size) <= got[g].rank_bound + 1 / v.size
        assert (got[g].rank_bound == 0) == (v.size <= k)


def test_sketches_of_days_merge(spark):
    k, probs = 64, (0.25, 0.5, 0.75)
    rng = np.random.default_rng(0)
    rows = [(d, "ab"[i % 2], float(x)) for d in range(6) for i, x in enumerate(rng.normal(d, 1, 1500))]
    t = spark.createDataFrame(rows, "day int, g string, v double")
    days = q.sketch(t, ("day", "g"), "v", k)
    first = q.merge(days.where("day < 3"), ("g",), k)
    both = q.merge(first.unionByName(q.merge(days.where("day >= 3"), ("g",), k)), ("g",), k)
    sizes = both.groupBy("g").agg(F.max(F.size("items")).alias("m")).collect()
    assert all(r.m <= k for r in sizes)
    for r in q.quantiles(both, ("g",), probs, k).collect():
        v = np.array([x for _, g, x in rows if g == r.g])
        assert r.n == v.size and off(v, r, probs, v.size) <= r.rank_bound
    assert q.quantiles(q.sketch(t.limit(0), ("g",), "v"), ("g",), probs).count() == 0


# --- mixing ---


def test_spread_goes_to_siblings_first():
    leaf = lambda n, share, cap: Node((n,), share, cap)
    a, b = Node(("a",), 0.5, 30, [leaf("a1", 1, 5), leaf("a2", 1, 25)]), Node(("b",), 0.5, 100, [leaf("b1", 1, 100)])
    assert spread([a, b], 40) == 0 and [x.budget for x in (*a.children, *b.children)] == [5, 15, 20]
    assert spread([a, b], 100) == 0 and [x.budget for x in (*a.children, *b.children)] == [5, 25, 70]
    assert spread([a, b], 200) == 70 and a.budget == 30 and b.budget == 100
    assert spread([], 5) == 5 and spread([leaf("z", 0, 9)], 5) == 5


def test_budgets():
    leaves = [("w", "en", "a", 100), ("w", "de", "a", 50), ("w", "en", "b", 10)]
    show = lambda nodes: {x.name: round(x.budget, 6) for x in nodes}
    got, size = budgets(leaves, {"a": (0.6, 1), "b": (0.2, 4), "c": (0.2, 9)}, None)
    assert size == pytest.approx(160) and show(got) == {("w", "de", "a"): 40, ("w", "en", "a"): 80, ("w", "en", "b"): 40}
    # b runs short: its part goes to the other source of its language.
    got, size = budgets(leaves, {"a": (0.5, 1), "b": (0.5, 2)}, 100)
    assert show(got) == {("w", "de", "a"): round(100 / 6, 6), ("w", "en", "a"): round(100 * 5 / 6 - 20, 6), ("w", "en", "b"): 20}


def test_budgets_of_short_languages_and_domains():
    leaves = [("w", "en", "a", 10), ("w", "de", "b", 100), ("v", "en", "b", 100)]
    show = lambda total: {x.name: round(x.budget, 6) for x in budgets(leaves, {"a": (0.5, 1), "b": (0.5, 1)}, total)[0]}
    assert show(60) == {("w", "en", "a"): 10, ("w", "de", "b"): 35, ("v", "en", "b"): 15}  # a language short: to the other language of its domain
    assert show(200) == {("w", "en", "a"): 10, ("w", "de", "b"): 100, ("v", "en", "b"): 90}  # a domain short: to the other domain
    assert show(10**6) == {("w", "en", "a"): 10, ("w", "de", "b"): 100, ("v", "en", "b"): 100}


def test_rounding_is_carried_on():
    rng = np.random.default_rng(3)
    borders = [(("d", f"l{i}", s), float(rng.uniform(0, n)), n) for s in "ab" for i, n in enumerate(rng.integers(5, 3000, 12).tolist())]
    take = rounded(borders)
    for s in "ab":
        own = [b for b in borders if b[0][-1] == s]
        assert abs(sum(n * take[leaf] - due for leaf, due, n in own)) <= max(n for _, _, n in own) / 2
        assert abs(sum(n * take[leaf] - due for leaf, due, n in own)) <= 200


def test_mixture(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " w" * int(rng.integers(1, 30)), "en" if i % 3 else "EN-us", "big" if i % 10 else "small") for i in range(3000)] + [(9001, None, "en", "big"), (9002, "", "en", "big"), (9003, "x", None, None), (9004, "x", "en", "else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_tokens", F.lit("extra"))
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 3), ("gone", 0.2, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixture(docs, targets)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "small", "gone"} and r["gone"].actual_share == 0
    assert r["small"].short and r["small"].taken_tokens == 3 * r["small"].n_tokens and r["big"].actual_share == pytest.approx(0.5 / 0.8, abs=0.002)
    c = chosen.collect()
    assert len({x.doc_id for x in c}) == len(c) and {x.lang for x in c} == {"en"} and all(1 <= x.copies <= (3 if x.source == "small" else 2) for x in c)
    assert {x.doc_id for x in c} == {x.doc_id for x in mixture(docs.repartition(7), targets)[0].collect()}
    assert {x.doc_id for x in c} != {x.doc_id for x in mixture(docs, targets, seed=8)[0].collect()}
    big = mixture(docs, targets, total=10**9)[1].collect()
    assert all(x.taken_tokens == x.n_tokens * x.max_repeats for x in big)
    full = {x.source: x for x in mixture(docs, targets, total="corpus")[1].collect()}
    assert sum(x.taken_tokens for x in full.values()) == pytest.approx(sum(x.n_tokens for x in full.values()), rel=0.01)
    parted = {x.source: x for x in mixture(docs.withColumn("part", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 4)), targets, domain="part")[1].collect()}
    assert parted["small"].short and parted["big"].actual_share == pytest.approx(0.5 / 0.8, abs=0.002)
    empty = mixture(docs.limit(0), targets)
    assert empty[0].count() == 0 and all(x.actual_share == 0 for x in empty[1].collect())


def test_shares_as_near_as_documents_allow(spark):
    """Many languages, long documents: a source that has documents to spare is within half a typical one of its share."""
    rng = np.random.default_rng(6)
    rows = [(i, " w" * int(rng.integers(20, 900)), ["en", "de", "fr", "es", "ja", "ko", "it"][i % 7], ["a", "b", "c", "d"][int(rng.integers(0, 10)) // 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.1, 1), ("c", 0.2, 1), ("d", 0.3, 4)], "source string, target_share double, max_repeats int")
    got = mixture(docs, targets)[1].collect()
    size = sum(x.taken_tokens for x in got)
    for x in got:
        assert x.short or abs(x.actual_share - x.target_share) * size <= x.n_tokens / x.n_docs / 2, x
    assert any(x.short for x in got)


# --- sentences ---

# ¦ stands where a unit starts, ¬ where it ends.
TEXTS = [
    "¦Dr. Ardovan checked it at approx. 3.5 m, i.e. behind the line.¬ ¦It works?!¬ ¦Yes¬",
    "¦We met Mr. J. R. Fox at 5 p.m.¬ ¦The U.K. branch (cf. p. 14) sent etc.¬ ¦No. 5 failed vs. 21 that passed.¬",
    "# ¦Results¬\n\n- ¦one thing¬\n- ¦Two. things?¬ ¦Three!¬\n\n¦Last line\nruns on.¬",
    "1. ¦First.¬\n2. ¦Second (sic!) goes on.¬\n\n> ¦“It works. Leave it alone,” said the note.¬ ¦Wait... the end.¬",
    '¦She asked, "Why 5?" and left.¬ ¦"All of it moved."¬ ¦(The run took 2 s.)¬ ¦Done¬',
    "¦« C’est fini. N’y touchez plus », disait M. Fox.¬ ¦Voir fig. 3, p. 7 !¬ ¦Bon.¬",
    "¦„Steht der Zähler?“, fragte er.¬ ¦Am 3. Mai fiel z. B. der Wert.¬ ¦Nr. 4 lief.¬",
    "## ¦25. Schritt: Laden¬\n¦Text.¬",
    "¦¿Está parado?¬ ¦La Sra. Fox vio 3,5 m, p. ej. tras la línea.¬ ¦¡Sí!¬",
    "¦Замер в 21 г. на участке, т. е. за линией.¬ ¦«Счётчик встал?» — спросила смена.¬ ¦Есть доли и т. д.¬ ¦См. рис. 5.¬",
    "¦表の全体は「本当か？」と思うほど古い。¬¦「もう終わった。触るな。」と書いた。¬¦（同じ形を示す…。）¬¦比率は3.5だ¬",
    "¦他说：“别动它。”¬¦“停了吗？”值班员问道。¬¦结果（真的是3.5吗？）让人意外……¬¦整张表《读数？》显示。¬",
    "¦«هل توقف؟» سأل المناوب.¬ ¦قاس د. فوكس ٣ متر.¬ ¦نعم؟¬",
    "¦यह वही रूप है ।¬ ¦“क्या गणक रुका है?” पाली ने पूछा।¬ ¦हाँ!¬",
    "¦เซลล์นี้ต้องดูอีกครั้ง¬ ¦อัตราส่วน19.1เป็น75.11¬ ¦จบ¬",
    "¦It ended.¬¦Next one begins.¬ ¦Use a.b() and x.py then.¬\r\n\r\n* ¦Item\r\n  goes on¬\r\n* ¦Other¬",
    "  \n\n",
]


def test_marked_texts(spark):
    docs, want = [], []
    for i, t in enumerate(TEXTS):
        plain, at, start = "", 0, None
        for c in t:
            if c == "¦":
                start = at
            elif c == "¬":
                want.append((i, 3 + start, 3 + at))
            else:
                plain, at = plain + c, at + 1
        docs.append((i, "😀x\n" + plain + "\nend"))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("cell_no", F.lit("clash"))
    cells = spark.createDataFrame([(i, k, "text", 3, 3 + len(t.replace("¦", "").replace("¬", ""))) for i, t in enumerate(TEXTS) for k in (0, 1)] + [(0, 9, "code", 0, 3), (77, 0, "text", 0, 5)], "doc_id long, cell_no int, kind string, char_start long, char_end long")
    got = sentences(d, cells).collect()
    texts = dict(docs)
    assert all(texts[r.doc_id][r.sent_start : r.sent_end] == r.sentence for r in got)
    show = lambda xs: sorted((i, texts[i][a:b]) for i, a, b in xs)
    assert show((r.doc_id, r.sent_start, r.sent_end) for r in got) == show(want)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab A.!?。…\n\r#-*>1\"“”«»()「」  ก😀", max_size=40), min_size=5, max_size=60))
def test_places_are_kept(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in marked(d, "text", "m").collect():
        assert len(r.m.replace(MARK, "").replace(CUT, "")) == len(r.text)
    cells = spark.createDataFrame([(i, "text", 0, len(t) + 5) for i, t in enumerate(texts)], "doc_id long, kind string, char_start long, char_end long")
    seen: dict[int, int] = {}
    for r in sentences(d, cells).orderBy("doc_id", "sent_start").collect():
        assert texts[r.doc_id][r.sent_start : r.sent_end] == r.sentence and r.sentence.strip() and r.sent_start >= seen.get(r.doc_id, 0)
        seen[r.doc_id] = r.sent_end


def test_sentence_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "A b. " * 20_000)], "doc_id long, text string")
    cells = spark.createDataFrame([(1, "text", 0, 5), (2, "text", 0, 0), (3, "text", 0, 100_000)], "doc_id long, kind string, char_start long, char_end long")
    assert sentences(d, cells).count() == 20_000
    assert sentences(d.limit(0), cells).count() == 0 == sentences(d, cells.limit(0)).count()
    with_places = sentences(d, cells, with_text=False)
    assert with_places.columns == ["doc_id", "sent_start", "sent_end"] and with_places.exceptAll(sentences(d, cells).drop("sentence")).count() == 0
    assert BREAK not in "".join(r.sentence for r in sentences(d, cells).limit(5).collect())


LONG = [
    "He said “{}. {}” and then left. He came back.",
    "Il dit «{}. {}» et partit. Il revint.",
    "The count ({}. {}) was off. It was mended.",
    "他说「{}。{}」然后走了。他回来了。",
    "He said „{}. {}“ and then left. He came back.",
]


@pytest.mark.parametrize("size", [200, 3000, 100_000])
def test_quotations_of_any_length(spark, size):
    """A stop inside a quotation or bracket splits nothing, however far away its end is."""
    texts = [t.format("a b " * (size // 8), "C d " * (size // 8)) for t in LONG]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cells = spark.createDataFrame([(i, "text", 0, len(t)) for i, t in enumerate(texts)], "doc_id long, kind string, char_start long, char_end long")
    got = sentences(d, cells).orderBy("doc_id", "sent_start").collect()
    assert [r.doc_id for r in got] == [i for i in range(len(LONG)) for _ in (0, 1)]
    assert all(r.sentence == texts[r.doc_id][r.sent_start : r.sent_end] for r in got)


def test_long_texts_of_marks_end(spark):
    """Runs of one sign, unclosed marks and many units: the time stays in proportion."""
    n = 120_000
    texts = ["." * n, "“" * n, "(" * n + ")" * n, "a(" * n, "- " * n, "“" + "! " * n + "”", "A. " * n, "「。" * n, "x" * n + "." * n + " Y", "\n" * n, '"' * n]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cells = spark.createDataFrame([(i, "text", 0, len(t)) for i, t in enumerate(texts)], "doc_id long, kind string, char_start long, char_end long")
    assert sentences(d, cells).groupBy("doc_id").count().where("doc_id = 8").first()["count"] == 2


def test_no_unit_carries_its_cell(spark, data):
    import contextlib
    import io

    docs, cells = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "doc_cells"))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        sentences(docs, cells).explain("formatted")
    plan = out.getvalue()
    assert "Window" not in plan and "MapInArrow" not in plan
    top = [line for line in plan.split("(1)")[-1].split("\n") if line.startswith("Output")][-1]
    assert "__body" not in top
