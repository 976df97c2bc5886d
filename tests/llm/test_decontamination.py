import random
import re

from millrace.llm import decontamination
from tests.llm.odd import TEXTS, docs


def plain(text):
    lowered = (text or "").translate(str.maketrans(decontamination.UPPER_TEXT, decontamination.LOWER_TEXT))
    kept = re.sub(r"[\x00-\x08\x0E-\x1F!-/:-@\[-`{-\x7F]", "", lowered)
    return re.findall(r"[^\x20\x09-\x0D]+", kept)


def shingles(text):
    own = plain(text)
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} or {tuple(own)} - {()}


def runs(text):
    own = plain(text)
    return {tuple(own[i : i + n]) for n in range(1, 6) for i in range(len(own) - n + 1)}


def expected(rows, items):
    found = {}
    for i, t, *_ in rows:
        own = runs(t)
        for k, q in items:
            wanted = shingles(q)
            n = len(own & wanted)
            if wanted and n >= 0.8 * len(wanted) - 1e-9:
                found.setdefault((i, k), set()).add((n, len(wanted)))
    return found


def frame_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_every_contained_item_is_found(spark):
    rng = random.Random(5)
    vocabulary = [f"{c}ö{k}" for c in "abcÉx" for k in range(30)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 4) if k % 8 == 0 else rng.randint(5, 60)))) for k in range(40)]
    rows = []
    for k in range(200):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        own = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, max(1, len(own) // 8))):  # from whole to far from it
            own[rng.randrange(len(own))] = "other"
        at = rng.randint(0, len(text))
        mark = rng.choice(["", "!!", "###", ","])
        text = text[:at] + [w.upper() + mark for w in own] + text[at:]
        rows.append((k, rng.choice([" ", "\n", "  "]).join(text), "en", "a"))
    want = expected(rows, items)
    for slots in (decontamination.SLOTS, 64):  # filters so small that they let all through
        got = decontamination.contained(docs(spark, rows), frame_of(spark, items), slots=slots).collect()
        assert {(r.doc_id, r.item_id): {(r.n_shared, r.n_item)} for r in got} == want and len(got) == len(want)
    assert 20 < len(want) < 200


def test_odd_rows(spark):
    items = [(None, "one two three four five"), (1, None), (2, ""), (3, "one two three four"), (4, "one two three four five six"), (4, TEXTS[8][1][:4000]), (5, "One, TWO three\nfour five six!")]
    table = docs(spark)
    got = decontamination.contained(table, frame_of(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(expected(TEXTS, items))
    kept = decontamination.drop_contaminated(table, frame_of(spark, items[2:5]))
    assert kept.columns == table.columns and kept.count() == len(TEXTS) - 1
    assert decontamination.drop_contaminated(table, frame_of(spark, [])).count() == len(TEXTS)
    assert decontamination.contained(docs(spark, []), frame_of(spark, items)).count() == 0


def test_repeated_rows_and_items(spark):
    text = "a b c d e f g h"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (1, "z " + text, "en", "a")]
    got = decontamination.contained(docs(spark, rows), frame_of(spark, [(7, text), (7, text), (8, text), (8, "y " + text)])).collect()
    # two texts of document 1; item 8 has two texts, of which the second lies in neither whole but to 4 of 5 shingles
    assert sorted((r.item_id, r.n_item) for r in got) == [(7, 4)] * 2 + [(8, 4)] * 2 + [(8, 5)] * 2
    assert decontamination.drop_contaminated(docs(spark, rows), frame_of(spark, [(7, text)])).count() == 0
