import random
import re

import pyarrow as pa
import pytest

from descra.llm import line_dedup as ld


MASK = (1 << 64) - 1


def mixed(x):
    """The splitmix64 finalizer."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def hashed(b):
    total, power = 0, 1
    for x in b:
        total, power = total + (x + 1) * power, power * 0x9E3779B97F4A7C15 & MASK
    return mixed(total + mixed(len(b)) & MASK)


def low(values, i):
    return all(values[i] < values[j] for j in (i - 1, i + 1) if 0 <= j < len(values))


def chunks(text):
    """Bytes, bytes with the white space up to the next chunk (the first: from the text's begin), lines and words of each chunk, word by word."""
    t = text.encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", t)]
    of_words = [hashed(t[a:b]) for a, b in found]
    lines = []
    for i, (a, b) in enumerate(found):
        if i == 0 or low(of_words, i - 1) or b"\n" in t[found[i - 1][1] : a]:
            lines.append([])
        lines[-1].append((a, b))
    of_lines = [hashed(t[x[0][0] : x[-1][1]]) for x in lines]
    rolling = [mixed((p * 0x9E3779B97F4A7C15 + h) & MASK) for p, h in zip([0, *of_lines], of_lines)]
    parts = []
    for i, x in enumerate(lines):
        if i == 0 or low(rolling, i - 1):
            parts.append([])
        parts[-1].append(x)
    out = []
    for i, x in enumerate(parts):
        a, b = x[0][0][0], x[-1][-1][1]
        end = parts[i + 1][0][0][0] if i + 1 < len(parts) else len(t)
        out.append((t[a:b], t[a if i else 0 : end], len(x), sum(map(len, x))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_word_by_word(seed):
    texts = [t for _, t in corpus(seed)[0] if t and len(t) < 100000]
    c = ld.Chunks(pa.array(texts, pa.large_string()))  # all in one slice
    for i, t in enumerate(texts):
        of = range(int(c.at[i]), int(c.at[i + 1]))
        assert [(c.bytes(k), int(c.lines[k]), int(c.words[k])) for k in of] == [(b, n, w) for b, _, n, w in chunks(t)]


def spaced(t):
    """The words of bytes, each with the white space before and after it."""
    gaps = re.split(rb"[^ \t\n\x0b\x0c\r]+", t)
    found = re.findall(rb"[^ \t\n\x0b\x0c\r]+", t)
    return list(zip(gaps, found, gaps[1:]))


def brute(rows, least_lines=ld.LEAST_LINES, least_words=ld.LEAST_WORDS):
    """The rule, by dictionaries of whole chunks that are cut word by word, and edges that go on word by word."""
    cut, of = {}, {}
    for n, (d, t) in enumerate(rows):
        cut[n] = chunks(t) if t else []
        assert b"".join(x[1] for x in cut[n]) == (t or "").encode() or not (t or "").strip()
    owner = {}
    for n, (d, t) in enumerate(rows):
        if d is not None:
            for b, *_ in cut[n]:
                owner[b] = min(d, owner.get(b, d))

    def around(n, k):
        """The words before and after chunk k of row n, nearest first, each with the white space between."""
        parts = [x[1] for x in cut[n]]
        before = b"".join(parts[max(0, k - 3) : k])
        after = parts[k][len(parts[k].rstrip(b" \t\n\x0b\x0c\r")) :] + b"".join(parts[k + 1 : k + 4])
        return [(w, g) for _, w, g in spaced(before)][::-1], [(g, w) for g, w, _ in spaced(after)]

    for n, (d, t) in enumerate(rows):
        for k, (b, *_) in enumerate(cut[n]):
            if d is not None and owner[b] == d and b not in [x[0] for x in cut[n][:k]]:
                of.setdefault(b, []).append((n, k))
    # Of several rows of one owner, the least bytes around the chunk.
    raw = lambda n, k: (b"".join(x[1] for x in cut[n][max(0, k - 3) : k]), b"".join(x[1] for x in cut[n][k : k + 4]).rstrip(b" \t\n\x0b\x0c\r"))
    whose = {b: (min(x, key=lambda y: raw(*y)[0]), min(x, key=lambda y: raw(*y)[1])) for b, x in of.items()}
    out = []
    for n, (d, t) in enumerate(rows):
        seen, source = {}, []
        for k, (b, *_) in enumerate(cut[n]):
            if b in seen:
                source.append(((n, seen[b]),) * 2)
            else:
                source.append(whose[b] if d is not None and owner[b] < d else None)
            seen.setdefault(b, k)
        data = (t or "").encode()
        places = [0]
        for x in cut[n]:
            places.append(places[-1] + len(x[1]))
        text, at, k = b"", 0, 0
        while k < len(source):
            j = k
            while j < len(source) and (source[j] is None) == (source[k] is None):
                j += 1
            if source[k]:
                until = j
                while until < len(source) and source[until] is None:
                    until += 1
                run = cut[n][k:j]
                start = places[k] if k else len(data) - len(data.lstrip(b" \t\n\x0b\x0c\r"))
                stop = places[j - 1] + len(run[-1][1].rstrip(b" \t\n\x0b\x0c\r"))
                back, on = [], []
                for x, y in zip([(w, g) for _, w, g in spaced(data[at:start])][::-1], around(*source[k][0])[0]):
                    if x != y:
                        break
                    back.append(x)
                for x, y in zip([(g, w) for g, w, _ in spaced(data[stop : places[until] if until < len(source) else len(data)])], around(*source[j - 1][1])[1]):
                    if x != y:
                        break
                    on.append(x)
                n_words = sum(x[3] for x in run) + len(back) + len(on)
                if n_words >= least_words and (sum(x[2] for x in run) >= least_lines or n_words >= 50):
                    text += data[at : start - sum(len(x + y) for x, y in back)]
                    at = stop + sum(len(x + y) for x, y in on)
                    at += len(data[at:]) - len(data[at:].lstrip(b" \t\n\x0b\x0c\r"))
            k = j
        text += data[at:]
        out.append((d, t if t is None or not cut[n] else text.decode()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéüfg") for _ in range(r.randint(1, 7))) + r.choice(["", "", ",", "."])
    text = lambda n: "".join(word() + r.choice([" ", " ", " ", "  ", "\n", "\n\n"]) for _ in range(n))
    passages = [text(r.choice([10, 30, 60, 90])) for _ in range(6)]
    rows = [(None, passages[2] + passages[2]), (None, None), (500, None), (501, ""), (502, "\n \n"), (503, "one"), (3, text(40)), (3, text(40))]
    for d in range(60):
        parts = [text(r.randint(0, 40)) for _ in range(r.randint(1, 4))]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        rows.append((d * 7 % 61, "".join(parts)))
    return rows + [(903, "same " * 60), (904, "same " * 60), (905, "same " * 20), (906, "same " * 20), (900, rows[20][1]), (901, rows[20][1]), (902, "long line " * 20000)], passages


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows, _ = corpus(seed)
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id int, text string, hash long, key string").repartition(3)
    got = ld.deduplicate(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute(rows)
    assert ld.deduplicate(df.limit(0)).count() == 0


def test_long_passages_go_and_clean_texts_stay(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    lost = kept = 0
    rows, clean, passages = [], {}, []
    texts = {}
    for p in range(40):
        passage = " ".join(word() for _ in range(55))
        passages.append(passage)
        for d in range(3):
            before, after = (" ".join(word() for _ in range(30)) for _ in range(2))
            texts[p * 3 + d] = f"{before}{r.choice(' 	')}{passage}\n{after}"
            rows.append((p * 3 + d, texts[p * 3 + d]))
    for d in range(200, 240):
        clean[d] = "\n".join(["The same short line in all of them."] + [" ".join(word() for _ in range(20)) for _ in range(4)])
    df = spark.createDataFrame(rows + list(clean.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.deduplicate(df).collect()}
    assert all(got[d] == t for d, t in clean.items())
    for p, passage in enumerate(passages):
        kept += passage in got[3 * p]
        lost += sum(passage not in got[3 * p + d] for d in (1, 2))
        for d in (1, 2):
            before, after = texts[3 * p + d].split(passage)
            if passage not in got[3 * p + d]:
                assert got[3 * p + d] == before + after[1:]  # to the word
    assert kept == 40 and lost == 80
