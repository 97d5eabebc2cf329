import random

from tessera.llm import line_dedup


def brute(a, b, words, least):
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = total = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                total += words[j + n]
                n += 1
            if total >= least:
                out |= set(range(j, j + n))
    return sorted(out)


def test_repeated_and_crossed_passages():
    p, q = [1, 2, 3, 4, 5, 6], [11, 12, 13, 14, 15, 16]
    for a, b, want in (
        ([90, *p, 91], [80, *p, 81, *p, 82], [*range(1, 7), *range(8, 14)]),
        ([90, *p, 91, *p, 92], [80, *p, 81], list(range(1, 7))),
        ([90, *p, 91, *q, 92], [80, *q, 81, *p, 82], [*range(1, 7), *range(8, 14)]),
    ):
        assert line_dedup.common_lines(a, b, [10] * len(b), 50) == want


def test_common_lines_equal_brute_force():
    rng = random.Random(5)
    for _ in range(500):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(0, 25))] for _ in range(2))
        words = [rng.randint(1, 20) for _ in b]
        assert line_dedup.common_lines(a, b, words, 40) == brute(a, b, words, 40)


def test_repeated_passages_go_from_all_later_documents(spark):
    p, q = (" ".join(f"{c}{k}" for k in range(60)) for c in "pq")
    texts = [f"a\n{p}\nb\n{p}\nc\n{q}\nd", f"e\n{p}\nf", f"g\n{q}\nh\n{p}\ni\n{p}\nj"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {0: texts[0], 1: "e\nf", 2: "g\nh\ni\nj"}
