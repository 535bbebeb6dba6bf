from __future__ import annotations

import random
import re

from tallyloom.llm.license_texts import TEMPLATES
from tallyloom.llm.licenses import scan_licenses

WORD = re.compile("[a-z0-9]+")


def found(frame, templates=TEMPLATES, **more):
    return sorted(tuple(r)[:4] for r in scan_licenses(frame, templates, **more).collect())


def test_exact_places(documents):
    rnd = random.Random(1)
    filler = ["lorem", "ipsum", "dolor", "sit", "amet", "é", "license", "the"]
    rows, wanted = [], []
    for number, (name, text) in enumerate(TEMPLATES.items()):
        before = " ".join(rnd.choices(filler, k=rnd.randint(0, 30)))
        shown = text.upper() if number % 2 else text
        rows.append((number, f"{before}\n{shown}\n" + " ".join(rnd.choices(filler, k=9))))
        start = len(before) + 1
        wanted.append((number, name, start, start + len(text.rstrip(".").rstrip())))
    got = found(documents(rows))
    assert set(wanted) <= set(got)
    # the first words of one are the other, and two differ by one word
    alike = [{"Apache-2.0", "Apache-2.0 notice"}, {"CC-BY-4.0 notice", "CC-BY-SA-4.0 notice"}]
    names = list(TEMPLATES)
    assert all({names[g[0]], g[1]} in alike for g in set(got) - set(wanted))


def test_edited_and_repeated_copies(documents):
    text = TEMPLATES["MIT"]
    words = text.split(" ")
    edited = " ".join(w for i, w in enumerate(words) if i % 12)  # a word in twelve is missing
    added = " ".join(w + (" extra" if i % 12 == 5 else "") for i, w in enumerate(words))
    cut = " ".join(words[: len(words) // 2])
    notice = TEMPLATES["MIT notice"]
    rows = [(1, edited), (2, added), (3, cut), (4, f"{notice} " + "x " * 50 + notice)]
    got = found(documents(rows))
    assert [g[:2] for g in got] == [(1, "MIT"), (2, "MIT"), (4, "MIT notice"), (4, "MIT notice")]


def test_equals_exhaustive_search(documents):
    """Fingerprints lose no contiguous copy; what else is found has all words, with others between."""
    rnd = random.Random(5)
    templates = {"A": "a b c d e f", "B": "b c d x y", "C": "q r s t u v w"}
    rows = [(i, " ".join(rnd.choices("abcdefqrstuvwxyz", k=40))) for i in range(50)]
    for number, (i, text) in enumerate(rows[:30]):
        words = text.split()
        place = rnd.randint(0, 30)
        words[place:place] = templates[rnd.choice("ABC")].split()
        rows[number] = (i, " ".join(words))
    wanted = set()
    for i, text in rows:
        words = text.split()
        for name, template in templates.items():
            size = len(template.split())
            for at in range(len(words) - size + 1):
                if words[at : at + size] == template.split():
                    wanted.add((i, name, 2 * at, 2 * (at + size) - 1))
    got = set(found(documents(rows), templates, least_coverage=1.0, band=3))
    texts = dict(rows)
    for i, name, start, end in wanted - got:  # a copy within the band of another one
        assert any(g[:2] == (i, name) and abs(g[2] - start) <= 2 * 3 * 3 for g in got)
    for i, name, start, end in got - wanted:
        words = iter(texts[i][start:end].split())
        assert all(word in words for word in templates[name].split())


def test_every_copy_has_a_row(documents):
    notice = TEMPLATES["MIT notice"]
    long = TEMPLATES["ISC"]
    rows = [(1, f"{notice}\n" * 40), (2, f"{long}\n" * 7), (3, f"x {notice} {notice} y")]
    got = found(documents(rows))
    size = len(notice) + 1
    assert [g for g in got if g[0] == 1] == [(1, "MIT notice", size * i, size * i + size - 2) for i in range(40)]
    size = len(long) + 1
    assert [g for g in got if g[0] == 2] == [(2, "ISC", size * i, size * i + size - 2) for i in range(7)]
    assert len([g for g in got if g[0] == 3]) == 2


def test_short_and_evenly_changed_copies(documents):
    words = TEMPLATES["ISC"].split(" ")
    changed = " ".join("other" if i % 5 == 4 else w for i, w in enumerate(words))
    rows = [(1, "Released under MIT License"), (2, f"Released under MIT License\n{changed}")]
    assert [g[:2] for g in found(documents(rows))] == [(1, "MIT notice"), (2, "ISC"), (2, "MIT notice")]


def test_nulls_empty_and_repeats(documents):
    notice = TEMPLATES["MIT notice"]
    rows = [(1, None), (2, ""), (3, "the"), (None, notice), (5, notice), (5, notice)]
    got = scan_licenses(documents(rows), TEMPLATES).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "None"]
    assert scan_licenses(documents([]), TEMPLATES).count() == 0
