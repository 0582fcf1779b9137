"""Sentence runs: equal to a plain version of the same rules, with every kind of row."""

import random
import re

import pytest

from quarry.llm import substrings


def plain_sentences(text):
    """(words, start, end) of each sentence; end is where the next one starts."""
    found, own, start, last = [], [], None, 0
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        if own and "\n" in text[last : m.start()]:
            found.append((own, start))
            own = []
        if not own:
            start = m.start()
        own.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0]))
        last = m.end()
        if re.search(r"[.!?;:,。！？，]$", re.sub(r"(?<=.)[\"')\]}]{1,2}$", "", m[0])):
            found.append((own, start))
            own = []
    if own:
        found.append((own, start))
    return [(w, a, (found[k + 1][1] if k + 1 < len(found) else len(text))) for k, (w, a) in enumerate(found)]


def plain(rows):
    spans = {}
    for d, t in rows:
        s = plain_sentences(t or "")
        for i in range(len(s)):
            own, j = list(s[i][0]), i + 1
            while j < len(s) and (j - i < substrings.SENTENCES or len(own) < substrings.WORDS):
                own += s[j][0]
                j += 1
            if j - i >= substrings.SENTENCES and len(own) >= substrings.WORDS:
                spans.setdefault(tuple(own), []).append((d, i, j))
    gone = {}
    for places in spans.values():
        first = min((-1 if d is None else d, i) for d, i, _ in places)
        for d, i, j in places:
            if (-1 if d is None else d, i) != first:
                gone.setdefault(d, set()).update(range(i, j))
    out = []
    for d, t in rows:
        s, g = plain_sentences(t or ""), gone.get(d, set())
        if g:
            t = t[: s[0][1]] + "".join(t[a:b] for k, (_, a, b) in enumerate(s) if k not in g)
        n = sum(k in g and k - 1 not in g for k in range(len(s)))
        out.append((d, t, len(s), len(g), n))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [*"abcdefgh", "Été", "über", "日本", "end", 'quoted"', "(x)"]
    sentence = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(1, 14))) + r.choice([".", ",", "!", "?\n", ";", ".\"", "。", "\n\n"])
    passages = [" ".join(sentence() for _ in range(r.randint(2, 8))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [sentence() for _ in range(r.randint(0, 12))]
        for _ in range(r.choice([0, 0, 1, 2])):
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        rows.append((i, r.choice(["", " ", "\n"]) + " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_version(spark, seed):
    rows = corpus(seed)
    rows += [(100, None), (101, ""), (102, "   "), (103, rows[5][1]), (103, rows[5][1]), (None, rows[6][1]), (104, "word " * 50_000)]
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, n_spans int, pos string")
    got = sorted(((g.doc_id, g.text, g.n_sentences, g.n_removed, g.n_spans) for g in substrings.deduplicated(docs).collect()), key=str)
    assert got == plain(rows)


def test_cut_keeps_columns(spark):
    text = "one two three four five six seven eight nine ten, eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty. "
    docs = spark.createDataFrame([(1, text + "Own end.", 5), (2, "Before. " + text, 6), (3, text, 7)], "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, substrings.cut(docs).collect()))
    assert got == [(1, text + "Own end.", 5), (2, "Before. ", 8)]
    assert substrings.deduplicated(docs.limit(0)).count() == 0


def every_run(rows):
    """As plain, but over all runs of any number of sentences with enough words, not the shortest only."""
    spans, out = {}, []
    for d, t in rows:
        s = plain_sentences(t)
        for i in range(len(s)):
            own = []
            for j in range(i, len(s)):
                own = own + s[j][0]
                if len(own) >= substrings.WORDS:
                    spans.setdefault(tuple(own), []).append((d, i, j + 1))
    gone = {}
    for places in spans.values():
        first = min((d, i) for d, i, _ in places)
        for d, i, j in places:
            if (d, i) != first:
                gone.setdefault(d, set()).update(range(i, j))
    for d, t in rows:
        s, g = plain_sentences(t), gone.get(d, set())
        if g:
            t = t[: s[0][1]] + "".join(t[a:b] for k, (_, a, b) in enumerate(s) if k not in g)
        out.append((d, t, len(g)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 3, 5])
def test_both_ends_cover_whatever_longer_runs_cover(spark, seed):
    # Other marks than line breaks, so that equal words are parted alike.
    rows = [(d, " ".join(t.split())) for d, t in corpus(seed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((g.doc_id, g.text, g.n_removed) for g in substrings.deduplicated(docs, both_ends=True).collect())
    want = every_run(rows)
    assert got == want
    assert 0 < sum(r[3] for r in plain(rows)) < sum(r[2] for r in want)


def test_planted_passages_go_as_a_whole(spark, tmp_path):
    from quarry.llm.queries import op1_substrings

    r = random.Random(4)
    words = lambda n: " ".join(f"v{r.randrange(10**9)}" for _ in range(n))
    # Its end has under 20 words behind the last run that fits; one long sentence; many short sentences.
    passages = [f"{words(30)}. {words(15)}. {words(3)}. {words(4)}.", f"{words(55)}.", " ".join(f"{words(4)}." for _ in range(14))]
    rows = [(i, f"{words(25)}. {passages[i % 3]} {words(25)}.") for i in range(12)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = {g.doc_id: g.text for g in op1_substrings(spark, path).collect()}
    for d, t in rows:
        p = passages[d % 3]
        assert got[d] == (t if d < 3 else t.replace(f"{p} ", ""))
    cut = {g.doc_id: g.text for g in substrings.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert cut == got
