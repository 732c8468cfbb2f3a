import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulara.llm import subjects as S
from tabulara.session import cut

LAW = "Putusan sela menyatakan gugatan hasil gugur. Panitera meminta agar akta penetapan dicabut. "
FILL = "Daftar hadir ditandatangani oleh semua yang datang. Beberapa hal lain dibahas pada kesempatan berikutnya. "
CARRY = "Hal itu diulang dua kali sebelum semua sepakat. "
ASIDE = "Perumpamaan yang dipilih pembicara adalah putusan sela. "


@pytest.fixture(scope="module")
def fitted(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    documents = spark.read.parquet(f"{d}/documents.parquet")
    encoded = cut(S.encode_sentences(documents))
    return d, encoded, S.fit_topics(encoded)


def areas(spark, d):
    return spark.read.parquet(f"{d}/subject_area.parquet")


def subjects_of(spark, d, model, *texts):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, words string, lengths int")
    out = {i: set() for i in range(len(texts))}
    for r in S.assign_subjects(cut(S.encode_sentences(df)), model, areas(spark, d)).collect():
        out[r.doc_id].add(r.subject)
    return out


def test_labels(spark, fitted):
    d, encoded, model = fitted
    labels = spark.read.parquet(f"{d}/doc_label.parquet").where("subject IS NOT NULL").select("doc_id", "subject").distinct()
    judged = spark.read.parquet(f"{d}/doc_label.parquet").select("doc_id").distinct()
    mine = S.assign_subjects(encoded, model, areas(spark, d)).join(judged, "doc_id", "left_semi").select("doc_id", "subject")
    hit, n, m = mine.join(labels, ["doc_id", "subject"], "left_semi").count(), mine.count(), labels.count()
    assert hit / n > 0.85 and hit / m > 0.85  # the labels themselves hold mistakes and omissions


def test_sentence_kinds(spark, fitted):
    d, _, model = fitted
    got = subjects_of(
        spark, d, model, LAW, LAW + FILL, FILL * 2 + ASIDE, LAW + FILL * 4, "Honor petugas dibayar bendahara. " + CARRY + FILL, FILL + CARRY * 3, None, "", " \n ", "Putusan sela\n\nGugatan hasil", "Tps | Sah\n1 | 2\n3 | 4",
        LAW.upper(), LAW.replace("l", "1"), "<p>" + LAW + "</p>", LAW * 3000, LAW, LAW,
    )
    assert got[0] == got[1] == got[11] == got[12] == got[13] == got[14] == got[15] == got[16] == {"hukum"}
    assert got[2] == got[3] == got[5] == got[6] == got[7] == got[8] == got[9] == got[10] == set()
    assert got[4] == {"anggaran"}


def test_arrays():
    codes = np.array([5, 6, S.END, S.END, 7, S.BREAK, 8, 9, S.END], dtype=np.int32)
    words, lengths = S.sentence_arrays(codes)
    assert words.tolist() == [5, 6, 7, 8, 9] and lengths.tolist() == [2, -1, 2]


def brute_expectations(texts, phi, alpha):
    stats = np.zeros(phi.shape)
    for terms, counts in texts:
        if not len(terms):
            continue
        theta = alpha + counts.sum() / len(alpha)
        for _ in range(S.INNER):
            new = alpha.astype(float).copy()
            for t, c in zip(terms, counts, strict=True):
                new += c * phi[t] * theta / (phi[t] * theta).sum()
            theta = new
        for t, c in zip(terms, counts, strict=True):
            stats[t] += c * phi[t] * theta / (phi[t] * theta).sum()
    return stats


def test_expectations_against_brute_force():
    rng = np.random.default_rng(1)
    model = S.TopicModel(np.arange(100, 130), rng.dirichlet(np.ones(30), 12).T.astype(np.float32), rng.dirichlet(np.ones(12)))
    lookup = model.lookup()
    bags = [np.sort(rng.choice(np.arange(95, 135), rng.integers(0, 9), replace=False)).astype(np.int32) for _ in range(200)]
    words = [rng.integers(0, len(b), 3 * len(b)).astype(np.int32) for b in bags]
    texts = [S.modelled(b, w, lookup)[:2] for b, w in zip(bags, words, strict=True)]
    for (terms, counts), b, w in zip(texts, bags, words, strict=True):
        assert dict(zip((terms + 100).tolist(), counts.tolist(), strict=True)) == {int(x): int((b[w] == x).sum()) for x in b if 100 <= x < 130}
    got, _, n = S.expectations(iter(texts), model)
    assert np.allclose(got, brute_expectations(texts, model.phi, model.alpha()), atol=1e-3) and n == sum(c.sum() for _, c in texts)


def test_bound_rises():
    rng = np.random.default_rng(2)
    texts = []
    for i in range(120):
        terms = np.sort(rng.choice(np.arange(10) + 10 * (i % 3), 6, replace=False))
        texts.append((terms, rng.integers(1, 4, 6).astype(np.float32)))
    model, last = S.TopicModel(np.arange(30), rng.dirichlet(np.ones(30), 5).T.astype(np.float32), np.ones(5) / 5), -np.inf
    for _ in range(6):
        stats, bound, n = S.expectations(iter(texts), model)
        assert bound / n > last - 1e-3
        last, model = bound / n, S._raised(model.terms, stats)
    fitted = S.start_topics(texts, np.arange(30), 6)
    lead = fitted.phi.argsort(0)[-5:] // 10  # the five leading terms of each topic come from one group
    assert sum(len(set(t)) == 1 for t in lead.T) >= 4


def test_kinds_and_carrying():
    mass = np.array([[3, 0, 0, 1], [1, 1, 0, 0], [0.2, 0, 2, 1], [0, 0.1, 0.1, 5], [0, 0, 0, 0], [0, 2, 2, 0]], dtype=np.float32)
    kinds = S.sentence_kinds(mass)
    assert kinds.tolist() == [0, 0, 2, 3, 3, 1]
    assert S.carried(kinds, 2).tolist() == [0, 0, 2, 2, 2, 1] and S.carried(np.array([3, 3, 1, 3]), 2).tolist() == [3, 3, 1, 1]


def test_topics_are_named_by_inspected_terms(spark):
    areas = spark.createDataFrame([("hukum", "x", "y"), ("ramalan", "Ramalan cuaca", "Weather forecast"), ("hukum", "x", "y"), (None, "a", "b")], "subject string, title_id string, title_en string")
    known = S.areas_of(areas)
    assert list(known) == ["hukum", "ramalan", ""] and set(known["ramalan"]) == {S.bucket(w) for w in ("ramalan", "cuaca", "weather", "forecast")}
    words = ["hukum", "sidang", "cuaca", "weather", "antrean", "lain"]
    phi = np.array([[0.6, 0.3, 0, 0, 0, 0.1], [0, 0, 0.5, 0.4, 0, 0.1], [0, 0, 0, 0, 0.9, 0.1], [0.001, 0.001, 0, 0, 0, 0.998], [0.3, 0, 0.3, 0, 0.3, 0.1]], dtype=np.float32).T
    model = S.TopicModel(np.array([S.bucket(w) for w in words]), phi, np.ones(5) / 5)
    assert S.topic_subjects(model, known).tolist() == [0, 1, 2, 3, 3]


def test_empty_and_topics(spark, fitted):
    d, _, model = fitted
    areas = spark.read.parquet(f"{d}/subject_area.parquet")
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    encoded = cut(S.encode_sentences(empty))
    assert S.assign_subjects(encoded, S.fit_topics(encoded), areas).collect() == []
    top = S.topic_terms(spark.read.parquet(f"{d}/documents.parquet"), model, areas, 5)
    assert top.where(F.col("subject") == "hukum").count() >= 5 and top.groupBy("topic").count().where("count <> 5").count() == 0
    assert {r.subject for r in top.select("subject").distinct().collect()} >= {r.subject for r in areas.collect()}
    assert S.composition(S.assign_subjects(encoded, model, areas), areas).where("n_documents = 0").count() == 8
    assert S.assign_subjects(cut(S.encode_sentences(spark.createDataFrame([(1, LAW)], "doc_id bigint, text string"))), model, areas.where("false")).collect() == []


def test_long_tags_are_no_words():
    assert S.read_text('<a href="https://example.org/' + "x" * 200 + '">satu</a> <b>dua</b>') == ["satu", "dua"]


def test_every_text_takes_part_in_every_step(spark):
    """Topics of 2400 texts are those of EM over all of them, and one more step over all raises the bound no further."""
    rng = np.random.default_rng(5)
    words = [[f"{a}{b}{c}" for b in "aeiou" for c in "kmt"] for a in "bdfghjklnprstvwyz"]
    rows = [(i, " ".join(words[g][k] for g in rng.choice(len(words), 2) for k in rng.choice(15, 6)) + ".") for i in range(2400)]
    encoded = cut(S.encode_sentences(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)))
    model = S.fit_topics(encoded, topics=20)
    ints = lambda b: np.frombuffer(b, dtype=np.int32)
    texts = [S.modelled(ints(r.bag), ints(r.words), model.lookup())[:2] for r in encoded.collect()]
    whole = S.start_topics(texts, model.terms, 20)
    assert len(texts) == 2400 and np.allclose(model.phi, whole.phi, atol=1e-3) and np.allclose(model.weight, whole.weight, atol=1e-3)
    stats, bound, n = S.expectations(iter(texts), model)
    after = S.expectations(iter(texts), S._raised(model.terms, stats))[1]
    assert after - bound < S.RISE * abs(bound)


def test_texts_judged_together_are_judged_by_themselves():
    rng = np.random.default_rng(6)
    model = S.TopicModel(np.arange(100, 160), rng.dirichlet(np.full(60, 0.1), 9).T.astype(np.float32), rng.dirichlet(np.ones(9)))
    named = np.eye(4, dtype=np.float32)[rng.integers(0, 4, 9)]
    texts = []
    for i in range(150):
        lengths = rng.integers(1, 9, rng.integers(0, 7)) * rng.choice([1, 1, 1, -1], 1)
        bag, words = np.unique(rng.integers(90, 170, int(np.abs(lengths).sum())), return_inverse=True)
        texts.append((bag.astype(np.int32), words.astype(np.int32), lengths.astype(np.int32) if i % 3 else np.abs(lengths).astype(np.int32)))
    texts.append((np.array([5], np.int32), np.zeros(20000, np.int32), np.array([20000], np.int32)))
    judge = lambda some: S.texts_subjects(*(list(x) for x in zip(*some, strict=True)), model, model.lookup(), model.alpha(), named)
    found, n = judge(texts)
    each = [judge([t]) for t in texts]
    assert found.sum() > 100 and (found == np.concatenate([f for f, _ in each])).all() and (n == np.concatenate([m for _, m in each])).all()
    assert n.tolist() == [int((t[2] > 0).sum()) for t in texts]
