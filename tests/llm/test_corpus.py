"""Corpus operators against brute force, library results, planted cases and edge rows."""

import glob
import hashlib
import random
import re
from collections import defaultdict
from itertools import combinations, groupby

import pytest
import xxhash

from tidemark.llm.op01_feistel import Feistel, Pseudonyms, luhn, pseudonymise
from tidemark.llm.op02_chaining import K, chains, common_words, fuzzy_passages
from tidemark.llm.op03_style_tree import extract, main_text
from tidemark.llm.op04_merkle import merkle
from tidemark.llm.op05_bpe import default_vocabulary, encode
from tidemark.llm.op06_toxicity import score
from tidemark.llm.op07_mixing import source_mix, waterfill
from tidemark.llm.op08_exact import exact_groups
from tidemark.llm.op09_suffix import remove_repeats
from tidemark.llm.op10_simhash import near_groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def frame(spark, rows):
    """documents of (doc_id, text) or (doc_id, text, source) rows."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "web", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(3)


def prose(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edge_rows():
    rng = random.Random(1)
    same = prose(rng, 60)
    return [(None, same), (1, None), (2, ""), (3, " \t\n "), (4, same), (4, same), (5, same.upper()), (6, "x" * 3000),
            (7, prose(rng, 30000)), (8, "one two"), (9, "naïve \U0001f600 İß x " * 5), (10, "one two")]


def edge_frame(spark):
    """Edge rows with further columns named like those the operators use inside."""
    df = frame(spark, edge_rows())
    for name in ("key", "row", "fp", "rid", "seed", "a", "b", "toxic", "size", "pattern", "_id", "other"):
        df = df.selectExpr("*", f"n_chars AS `{name}`")
    return df


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "pseudonymise": pseudonymise, "merkle": merkle, "encode": encode, "source_mix": source_mix, "exact_groups": exact_groups,
    "remove_repeats": remove_repeats, "near_groups": near_groups,
    "score": lambda df: score(df, labels(df.sparkSession, [(4, 1, 1), (None, 0, None), (8, 0, 0)]), keep=["doc_id"])}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_empty_tables(spark, name):
    df = edge_frame(spark)
    out = OPERATORS[name](df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in edge_rows())
    assert OPERATORS[name](df.limit(0)).count() == 0


def test_passages_of_edge_rows_and_empty_tables(spark):
    rows = fuzzy_passages(edge_frame(spark)).collect()
    found = {(r.doc_id, r.other_id, r.similarity) for r in rows}
    assert (None, 4, 1.0) in found and {5, 4} in [{a, b} for a, b, _ in found] and len(rows) == 2
    assert fuzzy_passages(frame(spark, []).limit(0)).count() == 0


def test_extract_edge_pages(spark):
    schema = "page_id long, url string, html string, text string, host string"
    body = "<html><body><nav><a href='/'>Home</a></nav><article><p>First  &amp;\n part.</p><p>Second part.</p></article></body></html>"
    rows = [(1, "http://a.com/x", body, "t", "h"), (2, "http://a.com/y", None, "t", "h"), (3, None, "", "t", "h"),
            (4, "::", "<p>open <b>tag", "t", "h"), (1, "http://a.com/x", body, "t", "h")]
    out = extract(spark.createDataFrame(rows, schema)).collect()
    texts = {r.page_id: r.text for r in out}
    assert len(out) == 5 and texts[1] == "First & part.\nSecond part." and texts[2] == texts[3] == ""
    assert all(r.n_chars == len(r.text) for r in out)
    assert extract(spark.createDataFrame(rows, schema).limit(0)).count() == 0


def test_role_words_drop_whole_roles_only():
    for tag, attrs in [("article", "class='post no-sidebar'"), ("main", "class='with-sidebar'"), ("div", "class='content comments-open'"),
                       ("div", "class='col hidden-xs'"), ("section", "id='advertising-history'"), ("article", "class='search'")]:
        assert main_text(f"<body><{tag} {attrs}><p>Story.</p></{tag}></body>", {}) == "Story."
    assert main_text("<body><div class='overlay'><p>Lead.</p><main><p>Story.</p></main></div></body>", {}).endswith("Story.")
    kept = "<h2 id='related-work'>A</h2><h3 id='hidden-markov-models'>B</h3><p id='share-price'>C</p><h2 id='search'>D</h2>"
    assert main_text(f"<body><article>{kept}</article></body>", {}) == "A\nB\nC\nD"
    inline = "<p>one <span class=ad>buy</span><button>click</button><noscript>no</noscript>two</p>"
    assert main_text(f"<body><article>{inline}</article></body>", {}) == "one two"
    other = "<article><p>Story.</p></article><div class='comments'><article class='comment'><p>First!</p></article></div><div class=ad>x</div>"
    assert main_text(f"<body>{other}</body>", {}) == "Story."


def test_importance_decides_beside_and_inside_articles(spark):
    rng = random.Random(13)
    rows, want = [], {}
    teasers = [f"<article class='card'><p>Teaser {i} of the shop.</p></article>" for i in range(3)]

    def add(host, body, text):
        want[len(rows)] = text
        rows.append((len(rows), f"http://{host}/{len(rows)}", f"<html><body>{body}</body></html>"))
    for i in range(12):
        one, two, title = (prose(rng, n) for n in (40, 40, 5))
        # the story in a div, cards marked as articles
        add("teasers", f"<div class='story'><h1>{title}</h1><p>{one}</p></div>{''.join(teasers)}", f"{title}\n{one}")
        # title and lead before the article, one line that every page repeats inside it
        add("leads", f"<header><div class='logo'>Our paper</div><h1>{title}</h1></header><div class='lead'>{two}</div>"
            f"<article><p>{one}</p><blockquote>Read our terms.</blockquote></article><div class='bottom'>All rights reserved</div>",
            f"{title}\n{two}\n{one}")
    one, title = prose(rng, 40), prose(rng, 5)  # hosts of one page
    add("alone", f"<h1>{title}</h1><div>Menu</div><article><p>{one}</p></article>", f"{title}\n{one}")
    add("single", f"<div class='story'><p>{one}</p></div><article class='card'><p>Teaser</p></article>", f"{one}\nTeaser")
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == want


# --- pseudonyms

def test_feistel_permutes_its_domain():
    f = Feistel(b"k", "t", 997)
    assert sorted(map(f, range(997))) == list(range(997)) and all(f.inverse(f(v)) == v for v in range(997))


def test_pseudonyms_link_validate_and_invert(spark):
    text = "card 4111 1111 1111 1111 on 2024-02-29, ann.lee@example.org, ip 10.1.2.3, ssn 123-45-6789"
    rows = pseudonymise(frame(spark, [(1, text), (2, "again 4111111111111111"), (3, "no 4111 1111 1111 1112 card, 2024-02-31")])).collect()
    one, two, three = (next(r for r in rows if r.doc_id == i) for i in (1, 2, 3))
    assert {f.kind for f in one.found} == {"card", "date", "email", "ipv4", "ssn"}
    # dotted quads vary in width, all else keeps its layout
    assert len(re.sub(r"ip [\d.]+", "", one.text)) == len(re.sub(r"ip [\d.]+", "", text))
    card = re.sub(r"\D", "", next(f.pseudonym for f in one.found if f.kind == "card"))
    assert card == two.found[0].pseudonym and card != "4111111111111111" and luhn(card[:-1]) == int(card[-1])
    assert [f.kind for f in three.found] == ["account"] and Pseudonyms(forward=False).text(one.text)[0] == text


def test_values_beside_other_text_are_found_and_linked():
    names, back = Pseudonyms(), Pseudonyms(forward=False)

    def found(text):
        new, finds = names.text(text)
        assert back.text(new)[0] == text
        return [(k, text[a:b]) for k, a, b, _ in finds], [re.sub(r"[^0-9A-Z]", "", n) for *_, n in finds]
    iban, card = "ES91 2100 0418 4502 0005 1332", "4111 1111 1111 1111"
    assert found(f"{iban} EUR")[0] == [("iban", iban)] and found(f"{iban} EUR")[1] == found(iban)[1] == found(iban.replace(" ", ""))[1]
    for text in (f"ID42 {card}", f"{card} 12/27", f"{card} 123", f"{card} 1234", card.replace(" ", "") + " 123", f"{card} EUR"):
        kinds, new = found(text)
        assert [k for k, _ in kinds] == ["card"] and new == found(card)[1], text
    assert [k for k, _ in found("3782 822463 10005 1234")[0]] == ["card"]
    phones = ["+14155552671", "+1 415 555 2671", "+1 (415) 555-2671", "+1 415 555 2671 12", "+1 415 555 2671 2024-02-29"]
    assert len({found(p)[1][0] for p in phones}) == 1
    for text in ("+49 170 1234567", "+33 1 23 45 67 89", "+44 (0)20 7946 0958", "+4917012345678"):
        assert found(f"call {text}, please")[0] == [("phone", text)]
    for text in ("31/12/2024", "13/1/1999", "12/31/2024", "2024-12-31", "31.12.2024", "1/2/2024"):
        assert found(f"on {text}.")[0] == [("date", text)]
    one, two = (names.text(t)[1][0][3] for t in ("31/12/2024", "2024-12-31"))
    assert one.split("/") == two.split("-")[::-1]
    rng = random.Random(14)
    for _ in range(300):
        found("".join(rng.choice("0123456789") + rng.choice(["", "", " "]) for _ in range(rng.randrange(13, 18))))


# --- fuzzy passages

def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_words_is_the_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert common_words(a, b) == subsequence(a, b)


def test_best_chain_matches_brute_force():
    rng = random.Random(6)
    for _ in range(100):
        points = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(12)})
        best = {}
        for p in points:
            best[p] = K + max([0.0, *(best[q] - 0.1 * (p[0] - q[0] + p[1] - q[1]) for q in points if q[0] < p[0] and q[1] < p[1])])
        def value(chain):
            return sum(K for _ in chain) - 0.1 * (chain[-1][0] - chain[0][0] + chain[-1][1] - chain[0][1])
        found = chains(points)
        assert sorted(m for c in found for m in c) == points
        assert max(map(value, found)) == pytest.approx(max(best.values()))
        assert all(a[0] < b[0] and a[1] < b[1] for c in found for a, b in zip(c, c[1:]))


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(7)
    passages = [[f"p{i}_{j}" for j in range(60)] for i in range(12)]
    rows, expected = [], set()
    for i, passage in enumerate(passages):
        edited = list(passage)
        for j in (13, 31, 48):
            edited[j] = f"e{i}_{j}"
        for half, words in enumerate((passage, edited)):
            rows.append((2 * i + half, " ".join([prose(rng, 150), *words, prose(rng, 150)])))
        expected.add((2 * i, 2 * i + 1))
    shared = " ".join(f"s{j}" for j in range(55))
    rows += [(i, f"{prose(rng, 80)} {shared} {prose(rng, 80)}") for i in range(100, 160)]
    rows += [(i, prose(rng, 300)) for i in range(200, 240)]
    copy = prose(rng, 90)
    rows += [(i, copy) for i in range(300, 340)]
    out = fuzzy_passages(frame(spark, rows)).collect()
    pairs = {tuple(sorted((r.doc_id, r.other_id))) for r in out}
    assert {p for p in pairs if p[0] < 100} == expected
    assert not [p for p in pairs if 200 <= p[0] < 300 or 200 <= p[1] < 300]
    hot = [p for p in pairs if 100 <= p[0] < 200]
    assert len(hot) == 59 and {i for p in hot for i in p} == set(range(100, 160))  # a star, not all pairs
    assert {p for p in pairs if p[0] >= 300} == {(300, i) for i in range(301, 340)}
    texts = dict(rows)
    for r in out:
        a, b = texts[r.doc_id].split()[r.start:r.end], texts[r.other_id].split()[r.other_start:r.other_end]
        assert r.matched == subsequence(a, b) and r.similarity == pytest.approx(r.matched / max(len(a), len(b)))


def ties(rows):
    """Sets of doc_ids that rows of passages tie together."""
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i
    for r in rows:
        root[find(r.doc_id)] = find(r.other_id)
    return find


def test_fuzzy_passages_at_the_limit_are_found(spark):
    """Substituted words at 0.8 to 0.9 likeness, alone and beside a chance string, against brute force."""
    rng = random.Random(11)
    rows, near = [], []
    for i in range(120):
        size, edits = [(50, 5), (50, 8), (60, 10), (60, 12), (40, 0), (80, 16)][i % 6]
        passage = [f"q{i}_{j}" for j in range(size)]
        edited = list(passage)
        for j in rng.sample(range(1, size - 1), edits):
            edited[j] = f"e{i}_{j}"
        runs = [len(list(g)) for same, g in groupby(a == b for a, b in zip(passage, edited)) if same]
        stray = [f"c{i}_{j}" for j in range(6)] if i % 2 else []
        for half, words in enumerate((passage, edited)):
            tail = prose(rng, 15, 10**6).split() + stray
            rows.append((2 * i + half, " ".join([prose(rng, 60, 10**6), *words, *tail, prose(rng, 60, 10**6)])))
        if subsequence(passage, edited) >= 0.8 * size and sum(max(0, n - 4) for n in runs) > 1:
            near.append(i)
    find = ties(fuzzy_passages(frame(spark, rows)).collect())
    lost = [i for i in near if find(2 * i) != find(2 * i + 1)]
    assert len(near) > 100 and len(lost) <= len(near) // 50, lost


def test_passages_of_sentences_that_stand_singly_elsewhere_are_found(spark):
    rng = random.Random(12)
    rows, pairs = [], []

    def add(*parts):
        rows.append((len(rows), " ".join([prose(rng, 50, 10**6), *parts, prose(rng, 50, 10**6)])))
        return len(rows) - 1
    for i in range(40):
        sentences = [" ".join(f"t{i}_{n}_{j}" for j in range(30)) for n in range(2 + i % 2)]
        pairs.append((add(*sentences), add(*sentences)))
        for sentence in sentences:
            for _ in range(6):
                add(sentence)
    for i in range(20):  # alike at 0.9, each under 0.8 to other texts
        words = [f"u{i}_{j}" for j in range(60)]
        edited = [w if j % 11 else f"v{i}_{j}" for j, w in enumerate(words)]
        pairs.append((add(*words), add(*edited)))
        for _ in range(5):
            add(*(w if j % 20 > 6 else f"x{rng.random()}" for j, w in enumerate(words)))
    find = ties(fuzzy_passages(frame(spark, rows)).collect())
    assert [p for p in pairs if find(p[0]) != find(p[1])] == []


def test_passages_among_many_nearer_neighbours_are_found(spark):
    """Two texts alike at 0.9 whose runs of equal words also stand in 45 others each, so that these come between them in
    every order of what goes before and what follows."""
    rng = random.Random(13)
    rows, pairs = [], []

    def add(words):
        rows.append((len(rows), " ".join([prose(rng, 30, 10**6), *words, prose(rng, 30, 10**6)])))
        return len(rows) - 1
    for i in range(12):
        words = [f"u{i}_{j}" for j in range(60)]
        for j in range(0, 60, 10):
            for n in range(45):
                add(words[j:j + 10])
        pairs.append((add(words), add([w if j % 10 else f"v{i}_{j}" for j, w in enumerate(words)])))
    found = {tuple(sorted((r.doc_id, r.other_id))) for r in fuzzy_passages(frame(spark, rows)).collect()}
    assert [p for p in pairs if p not in found] == []


def test_passages_of_one_rare_and_frequent_seeds_are_found(spark):
    """Two texts share three lines that 70 others have too, and one five-word string of their own."""
    rng = random.Random(17)
    rows, pairs = [], []

    def add(words):
        rows.append((len(rows), " ".join([prose(rng, 30, 10**6), *words, prose(rng, 30, 10**6)])))
        return len(rows) - 1
    for i in range(8):
        lines = [[f"l{i}_{n}_{j}" for j in range(12)] for n in range(3)]
        for line in lines:
            for n in range(70):
                add(line)
        own = [f"o{i}_{j}" for j in range(5)]
        pairs.append(tuple(add([*lines[0], f"{side}1", *lines[1], f"{side}2", *own, f"{side}3", *lines[2]]) for side in "ab"))
    found = {tuple(sorted((r.doc_id, r.other_id))) for r in fuzzy_passages(frame(spark, rows)).collect()}
    assert [p for p in pairs if p not in found] == []


def test_passages_of_frequent_seeds_alone_are_found(spark, monkeypatch):
    """Two texts whose common lines stand in 70 others each, with other words before and after: neighbours in no order.
    The size of the cells that occurrences meet in changes no row."""
    import tidemark.llm.op02_chaining as op

    rng = random.Random(19)
    rows, pairs = [], []

    def add(words):
        rows.append((len(rows), " ".join([prose(rng, 30, 10**6), *words, prose(rng, 30, 10**6)])))
        return len(rows) - 1
    for i in range(6):
        lines = [[f"l{i}_{n}_{j}" for j in range(12)] for n in range(4)]
        for line in lines:
            for n in range(70):
                add(line)
        pairs.append(tuple(add([w for n, line in enumerate(lines) for w in (*line, f"{side}{n}")]) for side in "ab"))
    out = [tuple(r) for r in fuzzy_passages(frame(spark, rows)).collect()]
    assert {tuple(sorted(r[:2])) for r in out} == set(pairs)
    monkeypatch.setattr(op, "CELL", 16)
    assert sorted(out) == sorted(tuple(r) for r in fuzzy_passages(frame(spark, rows)).collect())


def test_repeated_lines_of_two_texts_are_matched_place_by_place(spark):
    """Seeds that stand more than once in both texts, one of them frequent: the matches are all pairs of places."""
    from tidemark.llm.op02_chaining import _known, _pack_chains, _unpack_chains, meetings

    rows = [(1, r, p, r == 1 and p < 9) for r in (1, 2, 3) for p in range(0, 30, 3 * r)] + [(2, 2, 50, True), (2, 3, 60, True), (3, 1, 70, False), (3, 3, 70, False)]
    places = spark.createDataFrame([(*r, 90) for r in rows], "seed long, rid long, pos int, done boolean, n long")
    want = {}
    for seed, rid, pos, done in rows:
        for other_seed, other, at, settled in rows:
            if seed == other_seed and rid > other and not (done and settled):
                want.setdefault((rid, other), set()).add((pos, at))
    assert {(r.rid, r.other): _known(r.asDict(recursive=True)) for r in meetings(places).collect()} == want
    found = [[(3, 90), (4, 91), (60, 120)], [(0, 0), (9, 7)]]
    assert [list(map(tuple, c.tolist())) for c in _unpack_chains(_pack_chains(found))] == found


def test_edges_of_shared_runs_are_seeds(spark):
    """Of every run of words that two texts share, the first and the last five-word string are seeds."""
    from tidemark.llm.op02_chaining import _pack_batches, find_seeds

    rng = random.Random(15)
    texts = [" ".join(rng.choice([f"k{j}", f"k{j}", f"r{rng.randrange(10**6)}"]) for j in range(200)) for _ in range(8)]
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").selectExpr(
        "rid", "rid AS id", "false AS copied", "200 AS n_words", "'' AS digest", "text").repartition(3)
    known = "array<struct<rid: long, id: long, copied: boolean, n_words: int, digest: string>>"
    packs = rows.mapInArrow(_pack_batches, f"pack long, known {known}, blob binary")
    seeds = {(r.rid, r.pos) for r in find_seeds(packs, 1600).select("rid", "pos").collect()}
    words = [t.split() for t in texts]
    for a in range(8):
        for b in range(8):
            same = [a != b and x == y for x, y in zip(words[a], words[b])] + [False]
            start = None
            for j, equal in enumerate(same):
                if equal and start is None:
                    start = j
                elif not equal and start is not None:
                    if j - start >= K:
                        assert {(a, start), (a, j - K)} <= seeds
                    start = None


# --- fingerprints, tokens, mix

def test_fingerprints_of_equal_and_edited_texts(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 80)) for i in range(20)] + [(50, "same text here"), (51, "same text here"), (52, None)]
    out = {r.doc_id: r for r in merkle(frame(spark, rows)).collect()}
    assert out[50].fingerprint == out[51].fingerprint and out[50].near_next == 1.0
    ordered = sorted(rows)
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        text, following = text or "", following or ""
        n = len(text) // 4
        edited = text[:len(text) - n] + following[:n]
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[i].n_chars == len(text)
        assert 0 <= out[i].near_next <= 1 and 0 <= out[i].near_edited <= 1
        if i < 20:
            assert out[i].near_edited > out[i].near_next


def test_encoding_matches_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(default_vocabulary()))
    tok.no_truncation()
    tok.no_padding()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(
        frame(spark, [(10**6 + i, t) for i, (_, t) in enumerate(edge_rows())]).select("doc_id", "text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in encode(docs).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_mix_meets_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 40)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    out = source_mix(frame(spark, rows)).collect()
    source = {r[0]: r[2] for r in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.size == len(rows[r.doc_id][1].split()) and 0 <= r.taken <= 3 * r.size
    named = {s or "\U0010ffff": n for s, n in sizes.items()}
    goal = waterfill(named, {s: 1.0 + i % 3 for i, s in enumerate(sorted(named))})
    for s in sizes:
        assert target[s] == pytest.approx(goal[s or "\U0010ffff"]) and abs(taken[s] - target[s]) <= 1
    again = {(r.doc_id, r.taken) for r in source_mix(frame(spark, rows[::-1])).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}


# --- toxicity

def test_held_out_texts_are_ranked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = score(docs, marks, keep=["doc_id"]).filter("held_out").join(marks, "doc_id").collect()
    pos, neg = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > 0.9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


# --- dedup

@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups_match_brute_force(spark, bits):
    rng = random.Random(10)
    rows = [(i, rng.choice(["a b", "ab", " ab\n", "b a", "", None, "\t", "abc", "a b"])) for i in range(300)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g}
    out = exact_groups(frame(spark, rows), capacity=2, bits=bits).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in out} == want
    assert {r.doc_id for r in out if r.kept} == {k for k, _, _ in want.values()}


def repeats(rows, length):
    seen = defaultdict(int)
    data = {i: (t or "").encode() for i, t in rows}
    for d in data.values():
        for p in range(len(d) - length + 1):
            seen[d[p:p + length]] += 1
    for i, d in data.items():
        cover = [False] * len(d)
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                cover[p:p + length] = [True] * length
        spans = sum(c and not (p and cover[p - 1]) for p, c in enumerate(cover))
        kept = bytes(b for b, c in zip(d, cover) if not c)
        yield i, (len(d), sum(cover), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", range(3))
def test_removed_bytes_match_brute_force(spark, seed):
    rng = random.Random(20 + seed)
    parts = [prose(rng, 30, 50) for _ in range(8)]
    rows = [(i, "".join(rng.choice([*parts, prose(rng, 20), "ab" * 30, "é" * rng.randrange(60)]) for _ in range(rng.randrange(5))))
            for i in range(60)] + [(100, None), (101, "z" * 300)]
    out = remove_repeats(frame(spark, rows), length=40, seed=10).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == dict(repeats(rows, 40))


@pytest.mark.parametrize("most", [1, 4])
def test_crowded_seeds_are_cut(spark, monkeypatch, most):
    """One passage in many surroundings, shorter or longer than the limit, and cut short at either end."""
    import tidemark.llm.op09_suffix as op09

    monkeypatch.setattr(op09, "GROUP", most)
    rng = random.Random(77)
    passage = prose(rng, 25)
    rows = []
    for i in range(80):
        a, b = rng.choice([(0, 39), (3, 43), (0, 60), (20, 90), (0, len(passage))])
        rows.append((i, rng.choice(["", "x", "xy", prose(rng, 9)]) + passage[a:b] + rng.choice(["", "z", prose(rng, 9)])))
    out = remove_repeats(frame(spark, rows), length=40, seed=10).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == dict(repeats(rows, 40))


@pytest.mark.parametrize("seed", range(200))
def test_shared_offsets_match_brute_force(seed):
    from tidemark.llm.op09_suffix import shared_offsets

    rng = random.Random(seed)
    contexts = {}
    for _ in range(rng.randrange(2, 9)):
        high = rng.randrange(6)
        low = rng.randrange(high + 1)
        text = [rng.choice("aab") for _ in range(high - low + 8)]
        text[high:high + 3] = "xyz"
        contexts["".join(text).encode(), high] = low
    windows = {c: {(d, c[0][c[1] - d:c[1] - d + 8]) for d in range(low, c[1] + 1)} for c, low in contexts.items()}
    for c, ranges in zip(contexts, shared_offsets(list(contexts), 8) if len(contexts) > 1 else []):
        others = set().union(*(w for o, w in windows.items() if o != c))
        assert {d for a, b in ranges for d in range(a, b + 1)} == {d for d, w in windows[c] if (d, w) in others}


def test_repeated_rows_bring_each_range_once(spark, monkeypatch):
    import tidemark.llm.op09_suffix as op09

    def counted(length, with_text):
        def run(batches):
            import pyarrow as pa
            for batch in batches:
                ranges = [[(r["first"], r["last"]) for r in found or ()] for found in batch.column("ranges").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(r) for r in ranges], pa.int64()), pa.array([len(set(r)) for r in ranges], pa.int64()),
                     pa.array([0] * len(ranges), pa.int64()), pa.array([""] * len(ranges))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        return run
    monkeypatch.setattr(op09, "_cut_batches", counted)
    text = prose(random.Random(16), 60)
    out = op09.remove_repeats(frame(spark, [(None, text)] * 30), length=40, seed=10).collect()
    assert len(out) == 30 and all(r.n_bytes == r.n_removed > 0 for r in out)


def plain_fingerprint(text):
    words = [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("most", [1, 32])
def test_near_groups_match_brute_force(spark, most):
    rng = random.Random(30)
    rows = []
    for i in range(40):
        words = prose(rng, 120).split()
        for j in range(5):
            rows.append((len(rows) * 7 % 1000, " ".join(words)))
            words[rng.randrange(120)] = f"n{i}_{j}"
    rows += [(2000 + i, t) for i, t in enumerate([None, "", " ", "a b", "A b", "a b c d"])]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    out = near_groups(frame(spark, rows), most=most).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{f:016x}", find(i)) for i, f in fps.items()}
    assert len({find(i) for i in fps}) < len(fps) - 10


# --- pipeline

def test_pipeline_stages_keep_columns_and_decisions(spark):
    import corpus_pipeline as p
    from tidemark.llm.common import save, table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        out = save(stage(spark, docs, sf), "test-stage")
        assert out.columns == columns and 0 < out.count()
        before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, out))
        assert after <= before
        if name == "toxicity":
            want = {r.doc_id for r in score(docs, table(spark, sf, "labels")).filter("predicted = 0").collect()}
        elif name == "exact dedup":
            want = {r.doc_id for r in exact_groups(docs).filter("kept").collect()}
        elif name.startswith("SimHash"):
            want = {r.component_id for r in near_groups(docs).collect()}
        else:
            want = {r.doc_id for r in source_mix(docs).filter("taken > 0").collect()}
        assert after == want, name
        docs = out
    assert p.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_dedup_decides_row_by_row(spark):
    """Null and shared ids: each text once, whatever ids its copies have."""
    import corpus_pipeline as p

    rng = random.Random(15)
    texts = [prose(rng, 80) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, t.replace(" ", "\n")) for t in texts] + [(None, t) for t in texts]
    rows += [(None, prose(rng, 80)), (7, prose(rng, 80)), (7, texts[0])]
    df = frame(spark, rows)
    out = p.exact_dedup(spark, df, "").collect()
    assert len(out) == 8 and len({r.text.replace("\n", " ") for r in out}) == 8
    assert {r.doc_id for r in out} == {*range(6), 7, None}
    out = p.near_dedup(spark, df, "").collect()
    assert len(out) == 8 and len({r.text.replace("\n", " ") for r in out}) == 8


def test_registered_queries():
    import __spark_entry__ as e

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
    assert not [f for f in glob.glob("tidemark/[!l]*/**/*.py", recursive=True) if ".llm" in open(f).read()]
