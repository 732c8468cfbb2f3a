import random
from datetime import datetime, timedelta

from tabulara.operators import orphans

REFS = "table_name string, row_no bigint, field string, key string, at timestamp_ntz, period string, spans int, n int, verdict string"
DIM = "field string, key string, begins timestamp_ntz, ends timestamp_ntz, extra int"
T0 = datetime(2019, 1, 1)


def brute(refs, dim):
    out = []
    for t, no, f, k, at, period, *_ in refs:
        if k is None or at is None:
            continue
        own = [(b or datetime(1, 1, 1), e or datetime(9999, 1, 1)) for df, dk, b, e, _ in dim if (df, dk) == (f, k)]
        if any(b <= at < e for b, e in own):
            continue
        out.append((t, no, f, "missing" if not own else "deleted" if any(b <= at for b, _ in own) else "later", period))
    return sorted(out)


def test_against_brute_force(spark, rows):
    rnd = random.Random(4)
    day = lambda a, b: T0 + timedelta(hours=rnd.randint(a * 24, b * 24))
    refs = []
    for i in range(3000):
        key = rnd.choice(["hot"] * 10 + [f"k{rnd.randint(0, 60)}", "late", None])
        at = day(0, 120) if rnd.random() > 0.01 else None
        refs.append((rnd.choice("ab"), i, rnd.choice(["id", "name"]), key, at, at and at.strftime("%Y-%m"), 1, 2, "x"))
    refs += refs[:50]
    dim = [("id", "hot", T0, T0 + timedelta(days=40), 0), ("id", "hot", T0 + timedelta(days=40), None, 0), ("name", "hot", T0 + timedelta(days=3), T0 + timedelta(days=5), 0), ("name", "hot", T0 + timedelta(days=50), None, 0)]
    dim += [("id", "late", T0 + timedelta(days=400), None, 0), ("name", "late", T0 + timedelta(days=9), T0 + timedelta(days=2), 0), ("id", None, None, None, 0)]
    for k in range(0, 50):
        for f in ("id", "name"):
            for _ in range(rnd.randint(0, 3)):
                b = day(0, 100)
                dim.append((f, f"k{k}", b if rnd.random() > 0.1 else None, rnd.choice([None, b + timedelta(days=rnd.randint(-3, 60))]), 0))
    dim += dim[:20]
    got = orphans.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(dim, DIM))
    assert rows(got) == sorted(brute(refs, dim), key=repr)
    assert sum(r.n_orphans for r in orphans.orphan_report(got).collect()) == len(brute(refs, dim))
    assert rows(orphans.orphan_counts(spark.createDataFrame(refs, REFS), spark.createDataFrame(dim, DIM))) == rows(orphans.orphan_report(got))


def test_all_light_and_all_heavy(spark, rows, monkeypatch):
    refs = [("a", i, "id", f"k{i % 7}", T0 + timedelta(days=i), (T0 + timedelta(days=i)).strftime("%Y-%m"), 0, 0, "") for i in range(200)]
    dim = [("id", f"k{i}", T0 + timedelta(days=20), T0 + timedelta(days=90), 0) for i in range(5)]
    for heavy in (1, 1 << 20):
        monkeypatch.setattr(orphans, "HEAVY_GROUPS", heavy)
        assert rows(orphans.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(dim, DIM))) == sorted(brute(refs, dim), key=repr)


def test_empty_sides(spark, rows):
    none, no_dim = spark.createDataFrame([], REFS), spark.createDataFrame([], DIM)
    assert rows(orphans.orphan_references(none, no_dim)) == [] and rows(orphans.orphan_counts(none, no_dim)) == []
    one = spark.createDataFrame([("a", 1, "id", "k" * 100_000, T0, "2019-01", 0, 0, "")], REFS)
    assert rows(orphans.orphan_references(one, no_dim)) == [("a", 1, "id", "missing", "2019-01")]
