import random

import pytest
from pyspark.sql import functions as F

from quire.llm import tokens
from quire.llm.packing import SumOfSquares, fill_report, pack, pack_sizes
from quire.llm.tokens import byte_table, decode_ids, encode_corpus, encode_texts, pieces, token_count, token_spans, tokenizer_path

TEXTS = ["", None, "hello world", "<|endoftext|>", "漢字 é \U0001f600 x", "a\x00b\u200b\n\n  c", "word " * 90_000, "x" * 30_000]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")


def test_round_trip_and_defined_ids(texts):
    got = encode_corpus(texts).withColumn("back", decode_ids(F.col("ids"))).orderBy("doc_id").collect()
    assert [r.back for r in got] == [t or "" for t in TEXTS] and got[0].ids == got[1].ids == []
    assert 50256 not in got[3].ids and got[2].ids == [31373, 995]
    assert [r[0] for r in texts.select(token_count(F.col("text"))).collect()] == [len(r.ids) for r in got]
    assert encode_corpus(texts.limit(0)).count() == 0


def test_spans_cover_characters(texts):
    r = texts.where("doc_id = 4").select("text", token_spans(F.col("text")).alias("s")).first()
    assert all(r.text[a.start : a.end] for a in r.s) and max(a.end for a in r.s) == len(r.text)


def test_pieces_give_the_same_ids():
    random.seed(1)
    text = " ".join("".join(random.choice("ab é漢1.,'\n") for _ in range(random.randint(1, 9))) for _ in range(400))
    path = tokenizer_path()
    cut = pieces(text, 50)
    assert "".join(cut) == text and len(cut) > 10
    assert sum(encode_texts(cut, path), []) == encode_texts([text], path)[0]
    assert pieces("x" * 500, 50) == ["x" * 500] and sorted(byte_table().values()) == list(range(256))
    with pytest.raises(FileNotFoundError):
        tokens.tokenizer_path("none.json")


def test_packing_invariants(spark):
    random.seed(2)
    sizes = [random.choice([0, 1, 5, 63, 64, 65, 200, 33, 31]) for _ in range(3000)] + [None]
    rows = spark.createDataFrame([(i, n, "x", 1) for i, n in enumerate(sizes)], "doc_id long, n int, container string, piece int")
    for per_task in (100_000, 200):
        got = pack(rows, F.col("n"), "doc_id", 64, per_task).collect()
        used, of = {}, {}
        for r in got:
            used[r.container] = used.get(r.container, 0) + r["size"]
            of.setdefault(r.doc_id, []).append((r.piece, r.start, r["size"]))
        assert max(used.values()) <= 64 and len(of) == len(sizes)
        assert all(sum(s for _, _, s in of[str(i)]) == (n or 0) for i, n in enumerate(sizes))
        assert all(len(of[str(i)]) == 1 for i, n in enumerate(sizes) if (n or 0) <= 64)
        least = -(-sum(n or 0 for n in sizes) // 64)
        assert len(used) <= 1.02 * least + 3
    assert pack(rows.limit(0), F.col("n"), "doc_id").count() == 0
    assert fill_report(pack(rows, F.col("n"), "doc_id", 64), 64).first().used == sum(n or 0 for n in sizes)
    with pytest.raises(ValueError):
        pack(rows, F.col("n"), "doc_id", 0)


def test_sum_of_squares_against_brute_force():
    random.seed(3)
    cap = 12
    fast = SumOfSquares(cap)
    bins = []
    for _ in range(300):
        s = random.randint(1, cap)

        def cost(bins):
            n = [0] * (cap + 1)
            for b in bins:
                n[cap - b] += 1
            return sum(x * x for x in n[1:])

        options = [cost(bins[:i] + [bins[i] + s] + bins[i + 1 :]) for i in range(len(bins)) if bins[i] + s <= cap] + [cost(bins + [s])]
        at = fast.place(s)
        bins = list(fast.used)
        assert cost(bins) == min(options) and 0 <= at < len(bins)
    assert pack_sizes([12, 6, 6], 12) == [0, 1, 1]
