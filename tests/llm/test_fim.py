"""Fill-in-the-middle against a plain reading of its definition."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from noticeloom.llm import fim

UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s:.)", "word": r"\A[ \t-\r]+|[^ \t-\r]+[ \t-\r]*"}


def plain_rows(rows, unit="line", seed=7, rate=100, spm=50):
    out = []
    for doc_id, text in rows:
        t = text or ""
        u = re.findall(UNITS[unit], t)
        assert "".join(u) == t
        h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not t or re.search("<[PSM]>", t) or h[2] % 100 >= rate:
            out.append((doc_id, len(u), "plain", None, None, t, t))
        elif h[3] % 100 < spm:
            out.append((doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            out.append((doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    return out


def texts():
    r = random.Random(3)
    rows = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one"), (6, "ends\n"), (7, "a <S> b\nc"), (8, "<P>"), (9, "x<\nS>\n<M\n>"), (10, "\r\n\r\n\u2028 é\n"), (None, "a\nb\nc"), (None, None)]
    rows += [(k, "".join(r.choice("aé€😀 \n\n<>PSM\t") for _ in range(r.randint(1, 400)))) for k in range(20, 90)]
    rows += [(k, "".join(r.choice(["ß" * 50, "x" * 300, "\n", " "]) for _ in range(4000))) for k in (100, 101)]
    rows += [(102, "é" * 200_000), (103, "\n" * 100_000), (5, "one"), (5, "two\nlines")]
    return rows


@pytest.mark.parametrize(("unit", "seed", "rate", "spm"), [("line", 7, 100, 50), ("char", 11, 60, 10), ("word", 7, 90, 90)])
def test_transform_and_restore(spark, unit, seed, rate, spm):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "o", 5, "k") for i, t in rows], "doc_id long, text string, Output string, N int, key string").repartition(3)
    out = fim.transform(docs, unit, seed, rate, spm)
    assert out.columns == ["doc_id", "text", "key", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_rows(rows, unit, seed, rate, spm)))
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert {x.key for x in out.collect()} == {"k"}


def test_empty_table_and_units(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.transform(none).count() == 0
    with pytest.raises(ValueError, match="units"):
        fim.transform(none, "page")


@pytest.mark.parametrize("unit", list(UNITS))
def test_checkpoints_are_sparse_and_cuts_exact(unit):
    r = random.Random(5)
    for _ in range(60):
        text = "".join(r.choice("ab é€😀\n \t") for _ in range(r.randint(0, 300)))
        raw, u = text.encode(), re.findall(UNITS[unit], text)
        index = fim.Checkpoints(raw, unit, step=r.choice([1, 3, 8]), scan=r.choice([1, 2, 7, 64]))
        assert (index.n, index.length) == (len(u), len(text))
        for k in range(len(u) + 1):
            head = "".join(u[:k])
            assert index.cut(k) == (len(head.encode()), len(head))
    index = fim.Checkpoints(b"a\n" * 100_000)
    assert len(index.bytes) == len(index.chars) == 100_000 // fim.STEP + 1
