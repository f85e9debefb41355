import re

import numpy as np
import pytest

from chronofold.llm import decontaminate as dc

ITEMS = [
    (1, "Ann has 12 apples and gives 5 apples to her friend Bob. How many apples does Ann have left after 3 days?"),
    (2, "The quick train left the old station at noon and reached the harbour before the evening rain began to fall."),
    (3, "short one here"),
    (4, None),
    (5, ""),
    (6, "12 7 9 33 5 1"),
]


def run(spark, docs, items=ITEMS, **kw):
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    return {(r["doc_id"], r["item_id"]): r for r in dc.leaks(d, b, **kw).collect()}


def filler(n, seed):
    return " ".join(f"f{x}" for x in np.random.default_rng(seed).integers(0, 9999, n))


def test_verbatim_and_reparameterised_and_clean(spark):
    q = ITEMS[0][1]
    other = q.replace("12", "40").replace("5", "8").replace("3", "2").replace("Bob", "Tim")
    broken = "Ann has 12 apples and gives 5 apples to her friend Bob. How many apples does Ann have left after 3 days?".split()
    docs = [
        (10, f"{filler(300, 1)}. {q} {filler(50, 2)}"),
        (11, f"{filler(30, 3)}.\n{other}\n{filler(900, 4)}"),
        (12, filler(2000, 5)),
        (13, ITEMS[1][1].upper()),
        (14, f"{filler(5, 6)}. Short one here. {filler(5, 7)}"),
        (15, "The quick train left the old station at noon and nothing else"),
        (16, None),
        (17, ""),
        (18, " ".join(broken[: len(broken) // 4])),
    ]
    got = run(spark, docs)
    assert set(got) == {(10, 1), (11, 1), (13, 2), (14, 3)}
    assert got[10, 1]["coverage"] == 1 and not got[10, 1]["reparameterised"]
    assert got[11, 1]["reparameterised"] and got[11, 1]["slot_consistency"] == 1
    assert got[10, 1]["first_word"] == 300


def test_inconsistent_slots_are_no_leak(spark):
    item = [(1, "take 7 red balls from the box then add 7 blue balls and 7 white balls to the box again")]
    same = "take 9 red balls from the box then add 9 blue balls and 9 white balls to the box again"
    mixed = "take 9 red balls from the box then add 4 blue balls and 6 white balls to the box again"
    got = run(spark, [(1, same), (2, mixed)], item)
    assert set(got) == {(1, 1)}


OUTER = set("!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~%$«»“”‘’…¿¡")


def plain_reading(text, reading):
    """The definition of a template: [(key, slot value or None)] of each word, and sentence ends."""
    words, out = [w for line in (text or "").splitlines() for w in [*line.split(), "\n"]], []
    number, ended = False, True
    for w in words:
        if w == "\n":
            if out:
                out[-1][2] = True
            continue
        core = w.strip("".join(OUTER))
        is_number = bool(re.fullmatch(r"[+-]?[$€£]?[0-9][0-9.,:/]*[%°a-zA-Z$€£]*", w.strip("()[],;!?\"'").rstrip(".:"))) and w[0] in "0123456789+-$€£("
        is_unit = not is_number and number and (core.lower() in dc.UNITS or w in ("%", "$", "€", "£"))
        is_name = not is_number and not is_unit and len(core) > 1 and core[0].isupper() and core[1:].islower()
        kind = "<number>" if is_number else "<unit>" if is_unit else "<name>" if is_name and (reading == 1 or reading == 0 and not ended) else None
        ends = w.rstrip("\"')”’»")[-1:] in ("", ".", "!", "?", ":")
        number, ended = is_number, ends
        if core or w in ("%", "$", "€", "£"):
            slot = kind if reading < 3 else None
            out.append([slot or core.lower(), (core or w) if slot else None, ends])
        elif out:
            out[-1][2] |= ends
    return out


def plain_leaks(docs, items, coverage=0.5, consistency=0.8):
    found = {}
    for i, item in items:
        for d, doc in docs:
            for reading in range(4):
                a, b = plain_reading(item, reading), plain_reading(doc, reading)
                size = min(8, len(a))
                places = [p for p in range(len(a) - size + 1) if size and 2 * sum(x[1] is not None for x in a[p : p + size]) <= size]
                met = [(q - p, p, q) for p in places for q in range(len(b) - size + 1) if [x[0] for x in a[p : p + size]] == [x[0] for x in b[q : q + size]]]
                if size < 4:
                    met = [m for m in met if (m[2] == 0 or b[m[2] - 1][2]) and (b[m[2] + size - 1][2] or m[2] + size == len(b))]
                for anchor in sorted({m[0] - k for m in met for k in range(4)}):
                    own = [m for m in met if anchor <= m[0] <= anchor + 3]
                    share = len({p for _, p, _ in own}) / len(places)
                    pairs = {(a[p + k][1], b[q + k][1]) for _, p, q in own for k in range(size) if a[p + k][1] is not None}
                    one = [x for x in pairs if sum(x[0] == y[0] for y in pairs) == 1 and sum(x[1] == y[1] for y in pairs) == 1]
                    agree = len(one) / len({x[0] for x in pairs}) if pairs else 1
                    if share >= coverage and agree >= consistency:
                        new = (reading, -share, -agree, min(q for _, _, q in own))
                        found[d, i] = min(found.get((d, i), new), new)
    return found


@pytest.mark.parametrize("seed,coverage,consistency", [(7, 0.5, 0.8), (8, 0.5, 0), (9, 0.3, 1), (10, 1, 0.5)])
def test_equals_the_definition(spark, seed, coverage, consistency):
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{i}" for i in range(20)] + ["5", "12,", "kg", "Paris", "Anna", "Rome.", "end.", "--", "(7)", "%", "yes"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    opening = text(9)  # shared by many items
    items = [(i, f"{opening if i % 3 == 0 else ''} {text(int(rng.integers(1, 25)))}") for i in range(20)]
    docs = []
    for i in range(36):
        words = items[int(rng.integers(20))][1].split()
        words = [str(int(rng.integers(90))) if w[:1].isdigit() and rng.random() < 0.5 else w for w in words]
        at = int(rng.integers(len(words) + 1))
        words = [words, words[:at] + ["put", "in"] + words[at:], words[: len(words) * 2 // 3]][i % 3]
        docs.append((i, f"{text(15)}{rng.choice([' ', chr(10), '. '])}{' '.join(words)}{rng.choice([' ', chr(10), '. '])}{text(8)} {opening}"))
    got = run(spark, docs, items, coverage=coverage, consistency=consistency)
    want = plain_leaks(docs, items, coverage, consistency)
    assert set(got) == set(want) and len(got) >= 5
    for k, r in got.items():
        assert (-r["coverage"], -r["slot_consistency"], r["first_word"]) == pytest.approx(want[k][1:])


def test_one_word_items_need_a_line_or_sentence(spark):
    items = [(1, "yes"), (2, "New York")]
    docs = [(10, "I said yes to that"), (11, "Well. Yes. Then"), (12, "a question\nyes\nand more"), (13, "in New York there"), (14, "Where?\n- New York\n"), (15, "yes"), (16, "yes and new york")]
    assert set(run(spark, docs, items)) == {(11, 1), (12, 1), (14, 2), (15, 1)}


def test_values_must_map_one_to_one_in_one_place(spark):
    item = [(1, "first add 3 cups of flour then add 4 cups of milk and at last stir in 5 cups of sugar with care")]
    merged = item[0][1].replace("4", "9").replace("3", "9").replace("5", "9")
    assert run(spark, [(1, merged)], item) == {}
    halves = item[0][1].split()
    apart = " ".join(halves[:11]) + f" {filler(60, 1)} " + " ".join(halves[9:])
    assert run(spark, [(1, apart)], item, coverage=0.7) == {}
    assert set(run(spark, [(1, item[0][1].replace("4", "6"))], item, coverage=0.9)) == {(1, 1)}


def test_empty_null_and_repeated(spark):
    assert run(spark, [], ITEMS) == {} and run(spark, [(1, "a b")], []) == {}
    q = ITEMS[1][1]
    got = run(spark, [(None, q), (None, q), (3, q), (3, q)], [*ITEMS, ITEMS[1], (None, "an item that has no id at all but some words")])
    assert set(got) == {(None, 2), (3, 2)}
    with pytest.raises(ValueError):
        run(spark, [], coverage=0)


def test_items_of_slots_are_found_verbatim(spark):
    items = [(1, "Compute 348 x 27 + 19"), (2, "The Great Gatsby Was Written By Scott Fitzgerald"), (3, "12 40 7 88 3 15 21 9 64 2 71"), (4, "Compute 512 x 33 + 18")]
    docs = [(10 + i, f"{filler(60, i)} {t} {filler(40, 50 + i)}") for i, t in items[:3]] + [(20, f"{filler(60, 9)}. {items[1][1]}, {filler(9, 8)}"), (21, filler(400, 10)), (22, "1 12 40 9 8")]
    got = run(spark, docs, items)
    assert set(got) == {(11, 1), (12, 2), (13, 3), (20, 2)}
    assert all(r["coverage"] >= 0.5 and not r["reparameterised"] for r in got.values())


def test_short_items_after_a_heading_and_in_lower_case(spark):
    items = [(1, "Which planet is closest to the sun?"), (2, "Tom and Mary met Peter and Paul near Berlin before Anna drove to Paris with Hugo"), (3, "Which train with 12 people leaves for Rome?")]
    docs = [
        (10, f"{filler(40, 1)} General knowledge quiz\n{items[0][1]} {filler(20, 2)}"),
        (11, f"{filler(40, 3)}, {items[0][1]}"),
        (12, f"{filler(40, 4)} - {items[0][1].lower()}"),
        (13, f"{filler(40, 5)} {items[1][1].lower()} {filler(20, 6)}"),
        (14, f"{filler(40, 7)} Quiz\nWhich train with 90 people leaves for Oslo? {filler(20, 8)}"),
        (15, f"{filler(40, 9)} which train with 90 people leaves for rome?"),
        (16, "Which moon is closest to the sun? Which planet"),
    ]
    got = run(spark, docs, items)
    assert set(got) == {(10, 1), (11, 1), (12, 1), (13, 2), (14, 3), (15, 3)}
    assert {k for k, r in got.items() if r["reparameterised"]} == {(14, 3), (15, 3)}
