"""Cards and IBANs among other groups of digits, against a plain search."""

import random
import re

from pulsegrid.llm import pii


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def runs(text):
    """(start, end) of the valid runs of whole groups that are to be taken, by the rule as it is stated."""
    groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", text)]
    best = []
    for i in range(len(groups)):
        ok = [j for j in range(i, len(groups)) if 13 <= len(d := re.sub(r"\D", "", text[groups[i][0] : groups[j][1]])) <= 19 and luhn(d)]
        best.append(max(ok) if ok else None)
    out, i = [], 0
    size = lambda k: groups[best[k]][1] - groups[k][0]
    while i < len(groups):
        j = best[i]
        if j is not None and not any(best[k] is not None and size(k) > size(i) for k in range(i + 1, j + 1)):
            out.append((groups[i][0], groups[j][1]))
            i = j
        i += 1
    return out


def masked(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.pseudonymise(rows, "k").collect()}


def test_groups_around_a_card(spark):
    card = "4111 1111 1111 1111"
    texts = [f"order 12 {card} paid", f"tel 555 {card} x", "id 7-4111-1111-1111-1111", f"{card} 99", f"7 {card} 123", f"1234 {card} 5678", f"1234567 {card}", f"{card} {card}", f"{card} 2024-01-31", f"{card} 31.01.2024 {card}", f"{card} 555-123-4567", f"1 {card} 10.0.0.1"]
    got = masked(spark, texts)
    for i, text in enumerate(texts):
        new = got[i].text
        assert "1111 1111 1111" not in new and "1111-1111" not in new and got[i].n_pii >= 1, (text, new)
        shape = r"\d+" if "10.0.0.1" in text else r"\d"  # octets may differ in length
        assert re.sub(shape, "0", new) == re.sub(shape, "0", text)
    one = masked(spark, [card])[0].text
    assert got[0].text == f"order 12 {one} paid" and got[5].text == f"1234 {one} 5678" and got[7].text == f"{one} {one}" and got[1].text == f"tel 555 {one} x"
    assert got[8].kinds.date == 1 and got[9].kinds.date == 1 and got[10].kinds.phone == 1 and got[11].kinds.ipv4 == 1


def test_random_groups_match_a_plain_search(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(300):
        groups = ["".join(rng.choice("0123456789") for _ in range(rng.choice([1, 2, 3, 4, 4, 4, 5, 6, 13, 16]))) for _ in range(rng.randrange(1, 9))]
        text = groups[0] + "".join(rng.choice(" -") + g for g in groups[1:])
        if len(re.sub(r"\D", "", text)) >= 13 and not re.search(pii.OTHER, text) and not re.search(f"{pii.DATE}|{pii.SSN}|{pii.PHONE}", text):
            texts.append(text)
    got = masked(spark, texts)
    n = 0
    for i, text in enumerate(texts):
        taken, new = runs(text), got[i].text
        n += len(taken)
        assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text)
        keep = list(text)
        for a, b in taken:
            assert luhn(re.sub(r"\D", "", new[a:b]))
            keep[a:b] = new[a:b]
        assert "".join(keep) == new, (text, new, taken)
        assert got[i].n_pii == (1 if taken else 0)
    assert n > 60


def test_iban_behind_another_group(spark):
    text = "AB12 DE89 3704 0044 0532 0130 00 end"
    new = masked(spark, [text, "DE89 3704 0044 0532 0130 00"])
    assert new[0].text == f"AB12 {new[1].text} end" and new[1].text != "DE89 3704 0044 0532 0130 00"


def test_values_at_the_ends_and_long_texts(spark):
    card = "4111 1111 1111 1111"
    got = masked(spark, [card[:-1], "1" * 5000, "12 " * 3000, f"{'x ' * 50_000}{card}"])
    assert got[0].text == card[:-1] and got[1].text == "1" * 5000 and len(got[2].text) == 9000
    assert card not in got[3].text and got[3].n_pii == 1
