"""Every stage of the corpus pipeline against plain Python, on its own input."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from palimpsest.llm import lines, mixing, pieces, rules

from .test_llm import WORD, brute_ratios, brute_stats, linked, text_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    block = "\n".join(text_of(70 + k, 9, 3000) for k in range(10))
    rows = [(i, "\n".join(text_of(100 * i + j, 9, 3000) for j in range(4 + i % 5)) + ("\n" + block + "\n" + text_of(i, 12, 3000) if i % 4 == 0 else "")) for i in range(60)]
    rows += [(100 + i, t + " extra words") for i, t in rows[:20]]  # near copies
    rows += [(200 + i, t) for i, t in rows[20:30]] + [(None, rows[31][1]), (None, text_of(999, 50)), (None, text_of(999, 50))]
    rows += [(3, text_of(998, 60, 3000)), (5, rows[5][1]), (300, None), (301, ""), (302, "a b c " * 40), (303, "too short")]
    return [(i, t, "en", ["a", "b", None][(i or 0) % 3], len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def stage(spark, folder, k, rows):
    out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, SCHEMA), folder)
    if k < 4:
        assert out.columns == list(corpus_pipeline.COLUMNS)
    return [tuple(r) for r in out.collect()]


def test_quality_stage(spark, folder):
    # few words, so that no two n-grams share a bucket and whole counts give the same ratios
    r = random.Random(4)
    rows = [(i % 60, " ".join(r.choice("abcdefgh" if i % 2 == 0 else "ghijkl") for _ in range(8 + i % 40)), "en", "s", i) for i in range(90)]
    rows += [x for x in corpus() if not x[1] or x[0] == 303]
    ratios = brute_ratios({k: t for k, (_, t, *_) in enumerate(rows)}, [k for k, x in enumerate(rows) if x[0] in range(0, 60, 2)])
    expect = []
    for k, x in enumerate(rows):
        n, _, _, _, repeats = brute_stats(x[1])
        if n >= 10 and 100 * repeats <= 20 * n and round(ratios[k], 9) >= rules.LEAST_RATIO:
            expect.append(x)
    out = stage(spark, folder, 0, rows)
    assert Counter(out) == Counter(expect) and 20 < len(out) < 70


def brute_lines(rows):
    """The rows without repeats of chunks, by the rule of the operator in plain Python."""
    from hashlib import md5

    chunks, first = [], {}
    for place, (i, t, *_) in enumerate(rows):
        own = (t or "").split("\n")
        h = [int(md5(x.encode()).hexdigest()[:12], 16) for x in own]
        at = lambda j: h[j] if j >= 0 else 0
        r = [(h[j] + lines.FACTOR * at(j - 1) + lines.FACTOR**2 * at(j - 2)) % lines.MODULUS for j in range(len(own))]
        starts = [j for j in range(len(own)) if j == 0 or (j + 1 < len(own) and r[j] < r[j - 1] and r[j] < r[j + 1])]
        for s, e in zip(starts, [*starts[1:], len(own)], strict=True):
            if sum(bool(WORD.search(x)) for x in own[s:e]) > 1:
                text = "\n".join(own[s:e])
                chunks.append((place, i, s, e, text))
                first[text] = min(first.get(text, (True, 10**9, 0)), (i is not None, i or 0, s))
    gone = {}
    for place, i, s, e, text in chunks:
        if (i is not None, i or 0, s) != first[text]:
            gone.setdefault(place, set()).update(range(s, e))
    out = []
    for place, (i, t, lang, source, _) in enumerate(rows):
        left = "\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in gone.get(place, ()))
        out.append((i, left if t is not None else None, lang, source, len(left) if t is not None else None))
    return out


def test_line_stage(spark, folder):
    rows = corpus()
    out, expect = stage(spark, folder, 1, rows), brute_lines(rows)
    assert Counter(out) == Counter(expect)
    assert sum(len(r[1] or "") for r in out) < sum(len(r[1] or "") for r in rows)


def test_near_stage(spark, folder):
    rows = corpus()
    component = linked([(k, t, "") for k, (_, t, *_) in enumerate(rows)], 5)
    members = {}
    for k, (c, n) in component.items():
        members.setdefault(c if n else -k - 1, []).append(rows[k])
    out = stage(spark, folder, 2, rows)
    assert len(out) == len(members)
    left = Counter(out)
    for own in members.values():
        least = min((r[0] for r in own if r[0] is not None), default=None)
        stayed = [r for r in set(own) if r[0] == least and left[r]]
        assert stayed, own
    assert not left - Counter(rows)


def test_mixing_stage(spark, folder):
    rows = corpus()
    out = stage(spark, folder, 3, rows)
    plan = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert sum(size(r[1]) for r in out) == sum(r.taken for r in plan)
    assert set(out) <= set(rows)
    times = Counter((r[0], size(r[1])) for r in out)
    expect = Counter()
    for r in plan:
        expect[r.doc_id, r.size] += r.repeats
    assert times == +expect
    clash = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA + ", _size int, _n int, _copy int, _row int")
    again = mixing.repeat_rows(clash, mixing.mix(clash))
    assert again.columns == clash.columns and again.count() == len(out)


def test_encoding_stage(spark, folder):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((i, tuple(library.encode(t or ""))) for i, t, *_ in rows)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert 0 < out.count() and len({r.doc_id for r in out.collect()}) <= len(corpus())


def test_stages_on_an_empty_table(spark, folder):
    for k in range(4):
        assert stage(spark, folder, k, []) == []
    assert corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_random_rows_survive(spark, folder):
    r = random.Random(1)
    odd = [(r.choice([None, 1, 2]), r.choice([None, "", "\n\n", "x", "é" * 5000, "same same " * 30]), None, r.choice([None, "s"]), None) for _ in range(40)]
    for k in range(4):
        stage(spark, folder, k, odd)


def test_python_workers_get_small_batches(spark, folder, monkeypatch):
    """No stage hands a Python worker more than 2 MB and a row at once; by Spark's own limits these 6.8 MB make one batch."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    frame = type(spark.range(0))
    plain, seen = frame.mapInArrow, []

    def watched(self, run, schema, *more):
        def held(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes < 5 << 19, f"a batch of {batch.nbytes} bytes"
                    yield batch

            yield from run(small())

        seen.append(schema)
        return plain(self, held, schema, *more)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    rows = [(i, text_of(i // 2, 400, 3000) + f" end{i}", "en", "s", 0) for i in range(3000)]
    at = f"{folder}/large.parquet"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(at)
    for k, calls, left in ((0, 2, None), (2, 3, 1500), (4, 1, 3000)):
        seen.clear()
        n = corpus_pipeline.STAGES[k][1](spark, spark.read.parquet(at).coalesce(1), folder).count()
        assert len(seen) >= calls and left in (None, n)


def test_encoding_works_on_small_slices():
    """What encoding 2 MB of text at once takes besides the model, in the objects that Python and numpy allocate."""
    model = pieces.load()
    shared = type("Shared", (), {"value": model})
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(700)), "text": [text_of(i % 7, 700, 3000) for i in range(700)]})
    assert batch.nbytes > 1 << 21
    list(pieces._encoded(shared)(iter([batch.slice(0, 7)])))
    tracemalloc.start()
    rows = sum(out.num_rows for out in pieces._encoded(shared)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 700 and peak < 50 << 20, f"{peak >> 20} MB"
