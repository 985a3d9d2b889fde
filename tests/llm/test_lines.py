import random

from versewright.llm import lines

WORDS = [f"word{i}" for i in range(500)]


def line(rnd, n):
    return " ".join(rnd.choices(WORDS, k=n))


def kept(spark, rows, **options):
    found = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    return {r.doc_id: r for r in found.collect()}


def test_alignment_of_two_documents():
    # Later document: x A B C y C; earlier one: A B z C.  (A B) and the first C lie in order.
    assert lines.aligned([9, 1, 2, 3, 8, 3], [1, 2, 7, 3]) == {1: 0, 2: 1}
    assert lines._cuts([9, 1, 2, 3, 8, 3], [9] * 6, [1, 2, 7, 3], [9] * 4, 15) == [(1, 2)]
    assert lines._cuts([9, 1, 2, 3, 8, 3], [9] * 6, [1, 2, 7, 3], [9] * 4, 9) == [(1, 2), (3, 3), (5, 5)]
    # Crossed: one passage is in order, the other has moved; lines that lie apart in both don't go.
    assert sorted(lines._cuts([1, 2, 3, 4], [10] * 4, [3, 4, 1, 2], [10] * 4, 20)) == [(0, 1), (2, 3)]
    assert lines._cuts([1, 5, 2, 6, 3], [10] * 5, [3, 7, 2, 8, 1], [10] * 5, 20) == []
    # In order, with other lines between them in the earlier document.
    assert lines._cuts([1, 2, 3], [10] * 3, [1, 7, 2, 8, 3], [10] * 5, 20) == [(0, 2)]
    assert lines._cuts([], [], [1], [30], 20) == [] and lines._cuts([0, 0], [0, 0], [0], [0], 1) == []


def windows(keys, words, least):
    """The shortest runs from each place and up to each, by trying all."""
    good = lambda a, b: all(keys[a:b + 1]) and sum(words[a:b + 1]) >= least
    out = set()
    for a in range(len(keys)):
        for b in range(a, len(keys)):
            if good(a, b) and (not good(a, b - 1) or not good(a + 1, b)):
                out.add((a, b))
    return out


def test_runs_by_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        keys = [rnd.choice([0, 1, 2, 3, 4]) for _ in range(rnd.randint(0, 12))]
        words = [rnd.randint(1, 9) if k else 0 for k in keys]
        got = {(a, b) for a, b, _ in lines._runs(keys, words, 12)}
        assert got <= windows(keys, words, 12) | {(a, b) for a, b in got if sum(words[a:b + 1]) >= 12 and all(keys[a:b + 1])}
        # Every line of every passage with enough words is in a run (or a line of its own) within the passage.
        for a in range(len(keys)):
            for b in range(a, len(keys)):
                if all(keys[a:b + 1]) and sum(words[a:b + 1]) >= 12:
                    inside = {p for x, y in got if a <= x and y <= b for p in range(x, y + 1)} | {p for p in range(a, b + 1) if words[p] >= 12}
                    assert inside == set(range(a, b + 1))


def deleted(docs, least, align=lines._cuts):
    """All later documents with all that they and an earlier one nominate each other by, aligned one by one."""
    first, out, parts = {}, {}, {}
    for i in sorted(docs):
        keys, words = [hash(x) or 1 for x in docs[i]], [len(x.split()) for x in docs[i]]
        parts[i] = keys, words
        names = {k: n for k, n in zip(keys, words)}
        names |= {(a, tuple(keys[a:b + 1]))[1]: sum(words[a:b + 1]) for a, b, _ in lines._runs(keys, words, least)}
        shared = {}
        for name, n in names.items():
            if name in first:
                shared[first[name]] = shared.get(first[name], 0) + n
            first.setdefault(name, i)
        out[i] = {p for j, n in shared.items() if n >= least for a, b in align(keys, words, *parts[j], least) for p in range(a, b + 1)}
    return out


def test_documents_by_brute_force(spark):
    rnd = random.Random(12)
    pool = [line(rnd, rnd.randint(2, 9)) for _ in range(40)]
    docs = {i: [rnd.choice(pool) if rnd.random() < 0.8 else line(rnd, 7) for _ in range(rnd.randint(1, 30))] for i in range(60)}
    for i in range(60, 90):
        source = docs[rnd.randrange(i)]
        at = rnd.randrange(len(source))
        docs[i] = docs[i - 60][:4] + source[at:at + rnd.randint(2, 9)] + [line(rnd, 5)] + source[:at][-3:]
    got = kept(spark, [(i, "\n".join(x)) for i, x in docs.items()], least_words=15)
    found = {i: {p for c in got[i].line_cuts for p in range(c.start, c.stop + 1)} for i in docs}
    assert found == deleted(docs, 15) and sum(map(len, found.values())) > 50
    # Without the alignment, each shared line would go.
    every = deleted(docs, 15, lambda keys, words, other, _, least: [(p, p) for p, k in enumerate(keys) if k in set(other)])
    assert found != every


def test_longest_rising_by_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        pairs = [(i, v) for i, v in enumerate(rnd.sample(range(20), rnd.randint(0, 8)))]
        best = 0
        for mask in range(1 << len(pairs)):
            picked = [v for (i, v) in pairs if mask >> i & 1]
            if picked == sorted(picked):
                best = max(best, len(picked))
        got = lines._longest_rising(pairs)
        assert len(got) == best and [v for _, v in got] == sorted(v for _, v in got)


def test_shared_passages_go_from_the_later_document(spark):
    rnd = random.Random(1)
    own = [[line(rnd, 12) for _ in range(6)] for _ in range(12)]
    passage = [line(rnd, 14) for _ in range(4)]
    single = line(rnd, 60)
    short = line(rnd, 6)
    docs = {
        0: own[0][:3] + passage + own[0][3:] + [short], 1: passage + own[1], 2: own[2] + passage[:2] + [single], 3: own[3] + [single] + passage,
        4: [short] + own[4], 5: own[0][:3] + passage + own[0][3:] + [short], 6: own[6][::-1], 7: passage[2:] + own[7] + passage[:2],
    }
    got = kept(spark, [(i, "\n".join(x)) for i, x in docs.items()])
    left = {i: r.text.split("\n") if r.text else [] for i, r in got.items()}
    assert left == {0: docs[0], 1: own[1], 2: own[2] + [single], 3: own[3], 4: docs[4], 5: [], 6: docs[6], 7: own[7]}
    assert got[3].line_partners == [0, 2] and got[0].line_cuts == []
    assert [tuple(c) for c in got[7].line_cuts] == [(0, 1), (8, 9)]


def test_every_line_keeps_its_first_copy(spark):
    """On random documents: nothing but whole runs of lines goes, and only what an earlier document holds."""
    rnd = random.Random(9)
    pool = [line(rnd, rnd.randint(1, 30)) for _ in range(60)]
    docs = {i: [rnd.choice(pool) if rnd.random() < 0.5 else line(rnd, 10) for _ in range(rnd.randint(0, 25))] for i in range(40)}
    docs[40] = docs[3] + docs[7]
    got = kept(spark, [(i, "\n".join(x)) for i, x in docs.items()], least_words=15)
    seen = set()
    for i in sorted(docs):
        gone = {k for c in got[i].line_cuts for k in range(c.start, c.stop + 1)}
        assert got[i].text == "\n".join(x for k, x in enumerate(docs[i]) if k not in gone)
        assert all(docs[i][k] in seen for k in gone)
        # A single line that's long enough goes wherever an earlier document has it.
        assert all(k in gone for k, x in enumerate(docs[i]) if x in seen and len(x.split()) >= 15)
        seen |= set(docs[i])
    assert got[40].text == ""


def test_a_passage_whose_lines_stand_earlier_in_another_order(spark):
    rnd = random.Random(6)
    passage = [line(rnd, 10) for _ in range(6)]
    own = [[line(rnd, 30) for _ in range(6)] for _ in range(9)]
    docs = {0: [x for pair in zip(own[0], passage[::-1]) for x in pair]}
    docs |= {i: own[i][:3] + passage + own[i][3:] for i in range(5, 9)}
    got = kept(spark, [(i, "\n".join(x)) for i, x in docs.items()])
    assert got[0].line_cuts == [] and got[5].line_cuts == []
    assert all(got[i].text.split("\n") == own[i] and 5 in got[i].line_partners for i in range(6, 9))


def test_a_very_common_passage(spark):
    rnd = random.Random(2)
    common = line(rnd, 55)
    rows = [(i, f"{line(rnd, 30)}\n{common}\n{line(rnd, 30)}") for i in range(3000)]
    got = kept(spark, rows)
    assert common in got[0].text and not any(common in r.text for i, r in got.items() if i)
    assert all(r.text.count("\n") == 1 for i, r in got.items() if i)


def test_odd_rows(odd, empty):
    found = lines.deduplicated(odd)
    rows = found.collect()
    assert len(rows) == 11 and set(odd.columns) <= set(found.columns)
    by_id = {r.doc_id: r for r in rows if r.doc_id}
    assert by_id[2].text is None and by_id[3].text == "" and by_id[5].text == "" and by_id[5].n_chars == 0
    assert by_id[4].n_chars == 510_000 and by_id[4].line_cuts == [] and by_id[4].fp == 1
    assert lines.deduplicated(empty).count() == 0


def test_null_ids_and_versions(spark):
    rnd = random.Random(5)
    text = line(rnd, 40)
    found = lines.deduplicated(spark.createDataFrame(
        [(None, text), (None, text), (9, text), (9, text + "\nmore"), (10, text)], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in found.collect()) == sorted([(0, ""), (0, ""), (9, text), (9, text + "\nmore"), (10, "")])
