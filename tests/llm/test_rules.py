"""Quality rules: statistics against Python, verdicts on planted outliers."""

import random
import re
from collections import Counter

from contactlake.llm import robust_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    counts, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            covered.update(range(i, i + 8))
    n, repeat = len(w), len(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat,
            n < 20 or 100 * repeat > 30 * n)


def stats(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) + rng.choice(["", "", ".\n"]) for _ in range(n))


def test_statistics(make_docs, odd_rows):
    rng = random.Random(1)
    phrase = "p q r s t u v w "
    texts = [phrase * 2, phrase + "x", phrase + prose(rng, 40) + " " + phrase, "a " * 30, "line one\nline one\n\n \nx# *|<>$%&", "w1 " * 7 + "w2"]
    rows = odd_rows + [(20 + i, t, "en", "a") for i, t in enumerate(texts)]
    out = R.judge(make_docs(rows, clashing=True)).collect()
    assert Counter((r.doc_id, stats(r)) for r in out) == Counter((r[0], brute(r[1])) for r in rows)
    # Too few rows for an estimate: the base rules alone decide.
    assert all(r.kept == (not r.base_failed) for r in out)
    assert R.judge(make_docs([])).count() == 0


def test_outliers_are_rejected_per_group(make_docs):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(60, 300)), "en", "a" if i % 3 else None) for i in range(450)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(rng, 100).split()), "en", "a") for i in range(40)]
    # In another source symbols are usual, so they are no outliers there.
    marked = [(2000 + i, " ".join(w + "###" for w in prose(rng, rng.randint(60, 300)).split()), "en", "marked") for i in range(150)]
    out = {r.doc_id: r for r in R.judge(make_docs(rows + junk + marked)).collect()}
    assert all(out[r[0]].kept for r in rows)
    assert not any(out[r[0]].kept for r in junk)
    assert all(out[r[0]].kept for r in marked)
    again = {r.doc_id: r.kept for r in R.judge(make_docs(rows + junk + marked).repartition(5)).collect()}
    assert again == {k: r.kept for k, r in out.items()}


def test_identical_rows_and_small_groups(make_docs):
    text = prose(random.Random(3), 90)
    same = [(i, text, None, None) for i in range(150)]
    small = [(500 + i, prose(random.Random(i), 80), "de", f"s{i % 40}") for i in range(120)]
    assert all(r.kept for r in R.judge(make_docs(same + small)).collect())


def test_small_groups_are_judged_by_their_language_or_all_rows(make_docs):
    rng = random.Random(4)
    # The large source without a name and its language are different groups.
    rows = [(i, prose(rng, rng.randint(60, 300)), "en", None) for i in range(400)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(rng, 100).split()), "en", "small") for i in range(50)]
    rare = [(2000 + i, prose(rng, 100), "xx", "a") for i in range(10)]
    rare_junk = [(3000 + i, " ".join(w + "###" for w in prose(rng, 100).split()), "xx", "a") for i in range(10)]
    out = {r.doc_id: r for r in R.judge(make_docs(rows + junk + rare + rare_junk)).collect()}
    assert all(r.outlier_distance is not None for r in out.values())
    assert all(out[r[0]].kept for r in rows + rare)
    assert not any(out[r[0]].kept for r in junk + rare_junk)
