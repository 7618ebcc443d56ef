"""The numbered operators against brute force, and their edge cases."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, decontamination, html_extract, language_id, pii, quality_rules, simhash_dedup, substring_dedup, toxicity, url_filter
from pulsegrid.llm.components import connected_components

DOC = "doc_id long, text string, source string, bucket string, chunk string, fp string"


def docs(spark, texts, ids=None):
    """Rows with columns whose names clash with names that operators use inside."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, "x", "y", "z") for i, t in zip(ids, texts, strict=True)], DOC)


def words(seed, n, size=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


EDGE = [None, "", " \n\t ", "one", "é ü ñ", "a b", "x " * 3000, "same same", "same same"]


# 4


def brute_repeats(rows, size):
    seen, out = set(), []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone[k : k + size] = [True] * size
            seen.add(key)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def test_substring_dedup_matches_brute_force(spark):
    shared = " ".join(words(1, 30))
    texts = [" ".join(words(2, 60)) + " " + shared, shared + " " + " ".join(words(3, 40)), " ".join(words(2, 60)), "tiny text", shared + " " + shared, *EDGE]
    for window in (3, 20):
        got = substring_dedup.remove_repeats(docs(spark, texts), window=window, chunk_bytes=100, bucket_windows=10).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(list(enumerate(texts)), window)
    assert all(sum(e - s for s, e in r.spans) == r.n_removed for r in got)


def test_sizes_keep_messages_in_proportion():
    assert substring_dedup.sizes(0, 8, 6, 100) == (0, 0)
    assert substring_dedup.sizes(800_000_000, 8_000_000, 6_000_000, 20_000_000) == (100, 134)
    a, b = (np.prod([float(x) for x in substring_dedup.sizes(t, 8_000_000, 6_000_000, 20_000_000)]) for t in (10**12, 10**14))
    assert 90 < b / a < 110


def test_substring_dedup_edges(spark):
    last = 2**63 - 1
    rows = substring_dedup.remove_repeats(docs(spark, ["a b c", "a b c", None], [last, last - 1, None])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (last - 1, 0), (last, 0)]
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0
    text = " ".join(words(5, 25))
    got = sorted(r.n_removed for r in substring_dedup.remove_repeats(docs(spark, [text] * 3, [7, 7, None])).collect())
    assert got == [0, 25, 25]


# 8


def brute_components(fps, ids, k):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(zip(ids, fps, strict=True), 2):
        if (a ^ b).bit_count() <= k:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [find(i) for i in ids]


def test_fingerprint_by_definition():
    import xxhash

    text = "The quick\tbrown FOX\njumps é over the quick brown fox jumps"
    low = [w.lower() for w in text.encode().split()]
    hashes = [xxhash.xxh64_intdigest(b" ".join(low[i : i + 3]), 42) for i in range(len(low) - 2)]
    expect = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash_dedup.fingerprint(text, 3) % 2**64 == expect
    assert simhash_dedup.fingerprint("Ab", 3) % 2**64 == xxhash.xxh64_intdigest(b"ab", 42)
    assert simhash_dedup.fingerprint(None, 3) == simhash_dedup.fingerprint(" \n", 3) == 0


@pytest.mark.parametrize("tile", [4, 4096])
def test_near_duplicates_match_brute_force(spark, tile):
    base = words(9, 300, 5000)
    texts = []
    for i in range(60):
        w = list(base) if i % 2 else words(100 + i % 7, 120, 5000)
        w[i % len(w)] = f"edit{i % 11}"
        texts.append(" ".join(w))
    texts += EDGE
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(docs(spark, texts), tile=tile).collect()}
    ids = sorted(got)
    assert [got[i].component_id for i in ids] == brute_components([got[i].fp % 2**64 for i in ids], ids, 3)


def test_every_block_choice_finds_every_link():
    """Whatever the number of blocks, two fingerprints within k bits share a key."""
    rng = random.Random(3)
    for k, blocks in ((3, 4), (3, 5), (3, 7), (7, 9)):
        masks = simhash_dedup.block_masks(blocks, blocks - k)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), k):
                b ^= 1 << bit
            assert any((a & m % 2**64) == (b & m % 2**64) for m in masks)


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 200).astype(np.uint64)
    b = a ^ np.uint64(0b1001001)
    fps = np.r_[a, b]
    table = simhash_dedup.pivot_table(fps)
    i, j = simhash_dedup.close(np.arange(200), np.arange(200) + 200, fps, table, 3)
    assert len(i) == 200 and len(simhash_dedup.close(np.arange(199), np.arange(1, 200), fps, table, 3)[0]) == 0


def test_rows_without_an_id_are_bridges(spark, monkeypatch):
    """0 and 63 are linked through 7 only, and so are components with ids by rows that have none."""
    prints = [(1, 0), (None, 7), (2, 63), (9, 63 | 7 << 20), (None, 1 << 60), (3, -1), (None, -8)]
    rows = spark.createDataFrame(prints, "doc_id long, fp long")
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda *_: rows)
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash_dedup.near_duplicates(rows).collect()]
    ids = [10 + i if d is None else d for i, (d, _) in enumerate(prints)]
    roots = brute_components([f % 2**64 for _, f in prints], ids, 3)
    assert len(got) == len(prints)
    assert {(d, f): c for d, f, c in got} == {(d, f): min((prints[i][0] for i, x in enumerate(roots) if x == r and prints[i][0] is not None), default=None) for (d, f), r in zip(prints, roots, strict=True)}


def test_near_duplicates_edges(spark):
    assert simhash_dedup.near_duplicates(docs(spark, [])).count() == 0
    rows = simhash_dedup.near_duplicates(docs(spark, ["a b c d", "a b c d", "q", "a b c d"], [5, None, None, 3])).collect()
    assert sorted((r.doc_id is None, r.component_id or -1) for r in rows) == [(False, 3), (False, 3), (True, -1), (True, 3)]


def test_verified_links_follow_similarity(spark):
    base = words(4, 400, 5000)
    near, far = list(base), list(base)
    near[200] = "other"
    for i in range(0, 400, 9):
        far[i] = f"edit{i}"
    out = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs(spark, [" ".join(x) for x in (base, near, far)]), 3, 20, verify=(5, 0.8)).collect()}
    assert out == {0: 0, 1: 0, 2: 2}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}
    for a, b in pairs:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a is not None and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root


# 6


def test_bpe_is_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    names = bpe.read_ranks(path)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(names)}, special_tokens={})
    rng = random.Random(0)
    texts = [*EDGE, "don't  stop\n\n  <|endoftext|> 12345", "ab" * 5000, "日本語のテキスト 🙂👍🏽", *("".join(rng.choice("abcdefg 'stréé12\n\t,.") for _ in range(200)) for _ in range(40))]
    for r in bpe.encode_decode(docs(spark, texts), path, P.PATTERN).collect():
        text = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == other.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    assert bpe.encode_decode(docs(spark, []), path, P.PATTERN).count() == 0


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"key{i}".encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slots) == list(range(3000))
    assert [table.find(k) for k in keys] == list(range(3000)) and table.find(b"stranger") == -1
    assert bpe.PerfectHash([]).find(b"a") == -1


# 3


def test_quality_counts(spark):
    text = "a b c d\na b c d\n\nx # y | z\n#$%"
    r = quality_rules.clean_lines(docs(spark, [text]), least_words=1, most_repeat=100).first()
    w = text.split()
    covered = set()
    for i in range(len(w) - 2):
        if sum(w[j : j + 3] == w[i : i + 3] for j in range(len(w) - 2)) > 1:
            covered |= {i, i + 1, i + 2}
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), len("".join(w)), 5, 1, len(covered))


def test_quality_words_are_cut_as_in_the_contract(spark):
    """U+00A0 and U+001C are parts of words, in menu lines too; rows without an id are judged like any other."""
    menu, joined = "Startseite Kontakt\nAccueil\nHome", "Home\u00a0About\nHome\x1cAbout"
    got = quality_rules.clean_lines(docs(spark, [menu, joined, menu], [1, None, None]), least_words=1, most_repeat=100).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_kept_words) for r in got) == [(0, 2, 2), (0, 4, 0), (1, 4, 0)]


def test_quality_lines(spark):
    good = "\n".join(" ".join(words(i, 15, 9000)) + "." for i in range(6))
    nav = "Home | About | Contact | Login"
    texts = [good, good + "\n" + nav + "\nAll rights reserved.\n" + good.split("\n")[0], "\n".join([nav + " " + " ".join(words(i, 20)) for i in range(5)] + [" ".join(words(77, 12))]), *EDGE]
    got = {r.doc_id: r for r in quality_rules.clean_lines(docs(spark, texts)).collect()}
    assert got[0].kept and got[0].clean_text == good
    assert got[1].kept and got[1].clean_text == good and got[1].n_dup_lines == 1
    assert not got[2].base_failed and not got[2].kept
    assert got[3].base_failed and got[3].n_words == 0 and not got[3].kept and got[9].base_failed
    assert quality_rules.clean_lines(docs(spark, [])).count() == 0


# 7


def test_masks_miss_no_two_substitutions():
    for gone in combinations(range(13), 2):
        assert any(all(s + o not in gone for o in m) for m in decontamination.MASKS for s in range(13 - decontamination.SPAN + 1))


def brute_overlap(doc, item, window=13, similarity=0.8):
    import re

    a, b = ([w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for t in (doc, item))
    n = min(window, len(b))
    best = max((sum(x == y for x, y in zip(a[i : i + n], b[j : j + n], strict=False)) for i in range(len(a)) for j in range(len(b) - n + 1)), default=0)
    return best if n and best >= similarity * n and (len(b) >= 13 or best == n) else None


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(8)
    items = [" ".join(words(20 + i, n, 3000)) for i, n in enumerate((40, 14, 9, 5, 13))]
    texts = []
    for i in range(40):
        w = items[i % 5].split()
        for at in rng.sample(range(len(w)), min(len(w), i // 8)):
            w[at] = f"sub{i}"
        texts.append(" ".join(words(i, 30)) + ", " + " ".join(w).upper() + ". " + " ".join(words(i + 1, 20)))
    texts += EDGE
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.best_overlap for r in decontamination.contaminated(docs(spark, texts), bench).collect()}
    want = {(i, j): b for i, t in enumerate(texts) for j, item in enumerate(items) if (b := brute_overlap(t, item))}
    assert {k: v for k, v in got.items() if k[1] in (0, 1, 4)} == {k: v for k, v in want.items() if k[1] in (0, 1, 4)}
    assert {k for k in want if k[1] in (2, 3)} <= set(got)
    by_join = decontamination.contaminated(docs(spark, texts), bench, most_broadcast=0)
    assert {(r.doc_id, r.item_id): r.best_overlap for r in by_join.collect()} == got
    assert decontamination.contaminated(docs(spark, []), bench).count() == 0
    assert decontamination.contaminated(docs(spark, texts), bench.where("false")).count() == 0


def test_no_allowed_substitution_hides_an_item(spark):
    """Every placement of every allowed number of substitutions is found, in the middle and hanging over the ends."""
    texts, agree, bench = [], [], []
    for length in range(3, 14):
        least = -(-4 * length // 5)
        for gone in combinations(range(length), length - least):
            assert length == 13 or any(not set(m) & set(gone) for m in decontamination.masks_for(length, 0.8))
        item = [f"b{length}v{i}" for i in range(length)]
        bench.append((length, " ".join(item)))
        for k in range(length - least + 2):
            for gone in combinations(range(length), k):
                texts.append(" ".join(["x y", *(f"s{i}" if i in gone else w for i, w in enumerate(item)), "z"]))
                agree.append((length, length - k, least))
        for cut in range(1, length):
            texts += [" ".join(item[cut:]), " ".join(item[:-cut])]
            agree += [(length, length - cut, least)] * 2
    table = spark.createDataFrame(bench, "item_id long, text string")
    for most in (2_000_000, 0):
        got = {(r.doc_id, r.item_id): r.best_overlap for r in decontamination.contaminated(docs(spark, texts), table, most_broadcast=most).collect()}
        assert got == {(i, n): a for i, (n, a, least) in enumerate(agree) if a >= least}


def test_decontamination_of_common_tokens_and_null_ids(spark):
    """A seed that most documents hold, items that repeat it, rows without an id."""
    texts = ["a " * 300, "a " * 12 + "b c d e", "a b " * 40, "q r s"]
    bench = spark.createDataFrame([(1, "a " * 40), (2, "a " * 13 + "z"), (3, "a b " * 10), (None, "q r s")], "item_id long, text string")
    rows = docs(spark, texts).union(docs(spark, ["q r s", "Q, R! s"], [None, None]))
    for most in (2_000_000, 0):
        got = {(r.doc_id, r.item_id): (r.window, r.best_overlap) for r in decontamination.contaminated(rows, bench, most_broadcast=most).collect()}
        assert got == {(0, 1): (13, 13), (0, 2): (13, 13), (1, 1): (13, 12), (1, 2): (13, 12), (2, 3): (13, 13), (3, None): (3, 3), (None, None): (3, 3)}


# 10


def luhn(digits):
    d = [int(c) for c in digits if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_pii_keeps_formats_and_links(spark):
    import datetime
    import re

    values = ["4390 7454 3616 6235", "4111-1111-1111-1111", "49.37.233.206", "2024-02-29", "25/12/1999", "12/25/1999", "123-45-6789", "+1 (582) 555-6684", "GB82 WEST 1234 5698 7654 32", "jo.smith99@mail.example.com"]
    texts = [f"first {v}, then {v}." for v in values] + ["card 4111-1111-1111-1112 date 2024-02-30 ip 999.1.1.1 v1.2.3.4.5", *EDGE]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, texts), "k").collect()}
    new = []
    for i, v in enumerate(values):
        a, b = re.fullmatch(r"first (.*), then (.*)\.", got[i].text).groups()
        assert a == b != v and got[i].n_pii == 2
        assert i == 2 or re.sub("[a-z]", "a", re.sub(r"\d", "0", a)) == re.sub("[a-z]", "a", re.sub(r"\d", "0", v))
        new.append(a)
    assert luhn(new[0]) and luhn(new[1]) and all(int(o) < 256 for o in new[2].split("."))
    datetime.date.fromisoformat(new[3])
    assert int(new[4][:2]) > 12 and int(new[5][:2]) <= 12
    iban = new[8].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[len(values)].text == texts[len(values)] and got[len(values)].n_pii == 0
    assert all(got[len(values) + 1 + i].text == t for i, t in enumerate(EDGE))
    assert pii.pseudonymise(docs(spark, []), "k").count() == 0


def test_pii_is_one_to_one(spark):
    ips = [f"10.0.{i // 256}.{i % 256}" for i in range(600)]
    days = [f"19{y:02d}-03-{d:02d}" for y in range(30, 50) for d in range(1, 29)]
    out = [r.text for r in pii.pseudonymise(docs(spark, ips + days), "k").collect()]
    assert len(set(out)) == len(ips) + len(days)
    other = [r.text for r in pii.pseudonymise(docs(spark, ips), "another").collect()]
    assert sum(a == b for a, b in zip(out, other, strict=False)) < 3
    phones = [f"{a}{b:02d}-{c}55-{1000 + b}" for a in (1, 5) for b in range(40) for c in (0, 7)]
    moved = [r.text for r in pii.pseudonymise(docs(spark, phones), "k").collect()]
    inside = lambda p: p[0] > "1" and p[4] > "1"
    assert len(set(moved)) == len(phones) and [inside(p) for p in moved] == [inside(p) for p in phones]


def brute_digits(digits, tweak):
    """The Feistel network over a string of digits, written out."""
    u, n = len(digits) // 2, len(digits)
    sizes, half = (10**u, 10 ** (n - u)), [int(digits[:u] or 0), int(digits[u:])]
    for i in range(1, pii.ROUNDS + 1):
        side = i % 2
        h = int(hashlib.sha256(f"{tweak}|{n}|{i}|{half[1 - side]}".encode()).hexdigest()[:15], 16)
        half[side] = (half[side] + h % sizes[side]) % sizes[side]
    return (f"{half[0]:0{u}d}" if u else "") + f"{half[1]:0{n - u}d}"


def test_pii_matches_brute_force(spark):
    """Cards by a plain network and check digit; dates by a plain network over days, walked until they are valid."""
    import datetime

    cards = ["4390 7454 3616 6235", "4111-1111-1111-1111", "378282246310005"]

    def card(text):
        body = brute_digits("".join(c for c in text if c.isdigit())[:-1], "k|card")
        check = next(d for d in "0123456789" if luhn(body + d))
        left = iter(body + check)
        return "".join(next(left) if c.isdigit() else c for c in text)

    def date(text):
        first = datetime.date(1900, 1, 1).toordinal() - 1
        day, near = datetime.date.fromisoformat(text).toordinal() - 1, lambda d: first <= d < first + 73049
        modern = near(day)
        low, wide = (first, 271) if modern else (0, 1912)
        while True:
            sizes, half = (wide - 1, wide), [(day - low) // wide, (day - low) % wide]
            for i in range(1, pii.ROUNDS + 1):
                side = i % 2
                half[side] = (half[side] + int(hashlib.sha256(f"k|date|yyyy-MM-dd|{i}|{half[1 - side]}".encode()).hexdigest()[:15], 16) % sizes[side]) % sizes[side]
            day = half[0] * wide + half[1] + low
            if day < 3652059 and near(day) == modern:
                return datetime.date.fromordinal(day + 1).isoformat()

    days = ["2024-02-29", "1900-01-01", "2099-12-31", "1899-12-31", "0001-01-01", "9999-12-31", "1582-10-10"]
    got = [r.text for r in pii.pseudonymise(docs(spark, [*cards, *days]), "k").orderBy("doc_id").collect()]
    assert got == [*map(card, cards), *map(date, days)]


def test_pii_takes_the_longest_valid_run(spark):
    texts = ["4111 1111 1111 1111 12/25", "4111 1111 1111 1111 123", "AT61 1904 3002 3457 3201 AND more", "AT61 1904 3002 3457 3201"]
    got = [r.text for r in pii.pseudonymise(docs(spark, texts), "k").orderBy("doc_id").collect()]
    assert got[0][:19] == got[1][:19] != texts[0][:19] and luhn(got[0][:19]) and got[0][19:] == " 12/25" and got[1][19:] == " 123"
    assert got[2][:24] == got[3] != texts[3] and got[2][24:] == " AND more"


def test_pii_edges(spark):
    rows = docs(spark, ["4111-1111-1111-1111"] * 3, [None, None, 4])
    assert len({r.text for r in pii.pseudonymise(rows, "k").collect()}) == 1
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(rows, "")
    assert pii.pii_key(spark) == pii.DEMO_KEY

# 9


def test_html_extraction(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href=x>Home</a> <a href=y>News</a></nav>"
        "<div class='ad'>Buy this now, it is a fine thing.</div><article><h1>A &amp; B</h1><p>First   paragraph of\n text, with <b>bold</b>ed words.<p>Ok.</article>"
        "<div id=comments><p>I liked this article a lot, thank you.</p></div><form>Name <input> go</form><footer>&copy; 2024 all rights</footer></body></html>"
    )
    pages = spark.createDataFrame([(1, "u", page, "k"), (2, None, None, "k"), (3, "v", "", "k"), (4, "w", "plain text, no markup at all here, but a sentence.", "k"), (5, "x", "<div><p>" * 3000 + "deep", "k"), (6, "y", "<p a='>x", "k")], "page_id long, url string, html string, text string")
    weights = html_extract.fit(pages.where("page_id = 1"), "html", 10)
    got = {r.page_id: r for r in html_extract.extract(pages, weights).collect()}
    assert got[1].text == "A & B First paragraph of text, with bolded words. Ok." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and len(got) == 6
    assert html_extract.extract(pages.where("false"), weights).count() == 0


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = 7
        costs = rng.normal(0, 2, n)
        edges = [(i, j, float(rng.random() * 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def energy(side, costs=costs, edges=edges):
            return sum(abs(c) for c, s in zip(costs, side, strict=True) if (c > 0) != s) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(energy([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(energy(html_extract.source_side(costs, edges)) - best) < 1e-6


# 2


def test_url_rules(spark):
    block, allow = ["example.com/en/", "net/es/", "net/fr/"], ["com/", "www.example.com/en/"]
    urls = ["http://A.Example.com/en/1?x", "https://www.example.com/en/", "http://example.com", "http://x.com/", "ftp://b.net/es/1#t", "http://net/fr/", "http://xnet/fr/", "http://x.org/en/", "no scheme", None, "", "http://", "http:///en/", "http://b.net/es?q=/es/", "http://y.com/en://z", "http://y.com/en://z"]

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        import re

        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        hits = [(len(r), r, v) for v, rules in (("allow", allow), ("block", block)) for r in rules if host and (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith(r[r.index("/") :])]
        return (host, path, *(max(hits)[1:] if hits else (None, "allow")))

    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for size in (64_000_000, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, block, allow, most_bytes=size).collect()}
        assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.where("false"), block, allow).count() == 0


def test_url_ties_and_long_hosts(spark):
    """Keys of one length: the alphabetically first, by either way; hosts of more labels than a filter could count; repeated rows without ids."""
    block, allow = ["a.com/", "com/z/"], ["com/x/"]
    urls = ["http://a.com/x/1", "http://a.com/z/", "http://b.com/x/", "http://" + "a." * 400 + "com/q", "http://" + "b." * 400 + "com/z/"]
    want = ["a.com/", "a.com/", "com/x/", "a.com/", "com/z/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[2])] * 2, "page_id long, url string")
    for size in (64_000_000, 0):
        got = url_filter.judge_urls(pages, block, allow, most_bytes=size).collect()
        assert {r.page_id: r.rule for r in got if r.page_id is not None} == dict(enumerate(want))
        assert [(r.rule, r.verdict) for r in got if r.page_id is None] == [("com/x/", "allow")] * 2


def test_cascade_ends(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit("/")).alias("key"))
    listed = [f"h{i}/" for i in range(0, 3000, 7)]
    levels = url_filter.build_cascade(keys, listed, most_levels=2)
    assert isinstance(levels[-1], url_filter.Listed)
    flags = keys.select("key", F.get(url_filter.passes(levels, spark)(F.array(url_filter.key_hashes(F.col("key")))), F.lit(0)).alias("f"))
    assert {r.key for r in flags.where("f").collect()} == set(listed)


def test_cascade_is_exact(spark):
    keys = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit("/")).alias("key"))
    listed = [f"h{i}/" for i in range(0, 5000, 37)]
    levels = url_filter.build_cascade(keys, listed)
    flags = keys.select("key", F.get(url_filter.passes(levels)(F.array(url_filter.key_hashes(F.col("key")))), F.lit(0)).alias("f"))
    assert {r.key for r in flags.where("f").collect()} == set(listed)
    small = [url_filter.Bloom(0, np.arange(8, dtype=np.uint64).reshape(-1, 2), 0.5)]
    assert url_filter.answer(small, np.arange(8, dtype=np.uint64).reshape(-1, 2)).all()


# 5 and 1


def test_language_id(spark):
    rng = random.Random(1)
    stems = {"aa": ["the", "ing", "th"], "bb": ["sch", "ung", "der"], "cc": ["que", "ción", "ar"], "dd": ["eau", "eux", "oi"], "ee": ["ij", "oe", "aan"], "ff": ["ski", "cz", "ow"]}
    rows = [(i, " ".join("".join(rng.choice(stems[l]) for _ in range(3)) for _ in range(40)), l) for i, l in enumerate(l for l in stems for _ in range(30))]
    table = spark.createDataFrame([*rows, (900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit(table.where("doc_id % 3 > 0"), "doc_id", "text", "lang", 1000)
    assert model.names == sorted(stems)
    got = language_id.predict_languages(table, model).join(table.drop("text"), "doc_id").where("doc_id % 3 = 0 and doc_id < 900").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id: r for r in language_id.predict_languages(docs(spark, EDGE + ["12 34 !"]), model).collect()}
    assert [und[i].lang_pred for i in (0, 1, 2, 9)] == ["und"] * 4 and und[3].lang_pred != "und"
    nothing = language_id.fit(table.where("false"), "doc_id", "text", "lang", 10)
    assert {r.lang_pred for r in language_id.predict_languages(docs(spark, ["word"]), nothing).collect()} == {"und"}


def test_codewords_are_apart():
    for n in (2, 3, 5, 9, 20):
        code = language_id.codewords(n)
        assert len(code) == n and min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 1


def test_toxicity_chain(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        spam, toxic = i % 3 == 0, i % 5 == 0
        w = words(i, 60, 3000) + (["%%%"] * 4 if spam else []) + ([rng.choice(["idiot", "loweiung", "loweien"])] * 2 if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(spam), int(toxic)))
    labels += [(0, 1, 1), (7, None, 1), (None, 1, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, spam int, toxic int")
    x, y = toxicity.training_rows(table, marks, ["spam", "toxic"], "doc_id", "text", 300)
    assert len(x) == 300
    links = toxicity.fit_chain(x, y)
    assert links[1].earlier.shape == (1,)
    got = {r.doc_id: r for r in toxicity.predict_chain(table, links).collect()}
    assert np.mean([got[i].is_toxic == (i % 5 == 0) and got[i].is_spam == (i % 3 == 0) for i in range(400)]) > 0.97
    edge = toxicity.predict_chain(docs(spark, EDGE), links).collect()
    assert len(edge) == len(EDGE) and not edge[0].is_toxic
    assert toxicity.predict_chain(docs(spark, []), links).count() == 0
    assert toxicity.fit_chain([], {"a": np.empty(0, bool)})[0].bias == -20.0


def test_toxicity_of_conflicting_and_repeated_labels(spark):
    rows = [(i, f"word{i % 7} and more", "x") for i in range(40)] + [(0, "word0 and more", "x")] * 50
    marks = [(i, int(i % 7 == 3)) for i in range(40)] + [(5, 1), (5, 0), (None, 1), (6, None)]
    x, y = toxicity.training_rows(spark.createDataFrame(rows, "doc_id long, text string, y0 string"), spark.createDataFrame(marks, "doc_id long, toxic int"), ["toxic"], "doc_id", "text", 30)
    assert len(x) == 30 and y["toxic"].sum() <= 8
    all_x, all_y = toxicity.training_rows(spark.createDataFrame(rows, "doc_id long, text string, y0 string"), spark.createDataFrame(marks, "doc_id long, toxic int"), ["toxic"], "doc_id", "text", 1000)
    assert len(all_x) == 40 and all_y["toxic"][5]


def test_toxicity_matches_a_plain_chain(spark):
    """The query's probabilities against the definition: sums of weights over a text's features, log odds handed on."""
    table = spark.createDataFrame([(i, t) for i, t in enumerate(["good words here", "an idiot, an idiot!", None, "", "idiot loweien " * 2000])] + [(None, "idiot")], "doc_id long, text string")
    slot = lambda w: toxicity.Slots()[w][0]
    at = np.sort(np.array([slot("idiot"), slot("good")], np.int32))
    weight = {slot("idiot"): 3.0, slot("good"): -1.0}
    w = np.array([weight[int(a)] for a in at])
    links = [toxicity.Link("a", at, w, np.zeros(0), -1.0), toxicity.Link("b", at, w / 2, np.array([0.7]), 0.25, 0.8)]
    for r in toxicity.predict_chain(table.union(table), links).collect():
        text = {0: "good", 1: "idiot", 4: "idiot", None: "idiot"}.get(r.doc_id, "")
        z = -1.0 + (weight[slot(text)] if text else 0.0)
        a = 1 / (1 + np.exp(-z))
        b = 1 / (1 + np.exp(-(0.25 + (weight[slot(text)] / 2 if text else 0.0) + 0.7 * np.log(min(max(a, 0.01), 0.99) / (1 - min(max(a, 0.01), 0.99))))))
        assert abs(r.p_a - a) < 1e-9 and abs(r.p_b - b) < 1e-9 and r.is_a == (a >= 0.5) and r.is_b == (b >= 0.8)


def test_language_scores_match_a_plain_decoder(spark):
    """Every text's language and score by loops over bits and n-grams."""
    rows = [(i, t, l) for i, (t, l) in enumerate([("the thing and that", "aa"), ("das ist der und", "bb"), ("que la una por", "cc")] * 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(table, "doc_id", "text", "lang", 100)
    texts = ["the und que", "der und ist", "por", "Ünd the 3"]
    for r in language_id.predict_languages(docs(spark, texts), model).collect():
        own = language_id.grams(texts[r.doc_id]).tolist()
        losses = []
        for code in model.code.tolist():
            losses.append(sum(rel * np.log1p(np.exp(-c * sum(float(model.weights[g, b]) for g in own) / len(own) ** 0.5)) for b, (c, rel) in enumerate(zip(code, model.reliability, strict=True))))
        best = int(np.argmin(losses))
        assert r.lang_pred == model.names[best] and abs(r.score - 1 / sum(np.exp(losses[best] - x) for x in losses)) < 1e-4


def test_digest_columns(spark):
    text = "a b c"
    out = substring_dedup.remove_repeats(docs(spark, [text])).select(F.sha2(F.col("kept_text").cast("binary"), 256).alias("h")).first()
    assert out.h == hashlib.sha256(text.encode()).hexdigest()
