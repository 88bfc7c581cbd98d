"""Conversation repair, link trust and spelling forms against brute force, planted cases and edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm.op11_repair import INSERT, MODULUS, Chain, Repaired, damage, illegal, repair, solve
from tidemark.llm.op12_link_trust import STEPS, UNIT, judge
from tidemark.llm.op13_spelling import spelling_forms

WS = " \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- conversation repair
def brute(rows):
    """Every edit string with at most two inserts in a gap: least (cost, audit) and its repaired lines.
    ``rows``: (role, text, must be deleted, truncated)."""
    best = None

    def walk(i, initials, audit, cost, lines, run):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
        if not re.fullmatch("s?(ua)*u?", initials):
            return
        if run < 2:
            for r in ("user", "assistant"):
                walk(i, initials + r[0], audit + "I", cost + INSERT, [*lines, r + ":"], run + 1)
        if i < len(rows):
            role, text, drop, late = rows[i]
            walk(i + 1, initials, audit + "D", cost + 4, lines, 0)
            if not drop:
                if role:
                    walk(i + 1, initials + role[0], audit + "K", cost + 3 * late, [*lines, role + ":" + text], 0)
                for r in ("user", "assistant"):
                    walk(i + 1, initials + r[0], audit + "R", cost + 3 + 3 * late, [*lines, r + ":" + text], 0)

    walk(0, "", "", 0, [], 0)
    return best


def chained(rows, most, modulus=MODULUS):
    coded = [(role[:1], 1, drop, late) for role, _, drop, late in rows]
    chain = Chain()
    for lo in range(0, len(coded), most):
        part = coded[lo:lo + most]
        chain.add(part[0][0], part[-1][0], illegal(part), *zip(*solve(part, range(4), modulus)))
    done = Repaired(chain.result()[1])
    for role, text, _, _ in rows:
        done.row(role, text, 1)
    done.inserts()
    return (*chain.result(), chain.illegal, done.digest.hexdigest())


@pytest.mark.parametrize("modulus", [MODULUS, 2, 1])
def test_repair_is_the_cheapest_and_least_edit_string(modulus):
    """Moduli 1 and 2 make hashes collide, so that their verification decides."""
    rng = random.Random(11)
    for n in [0, 1, 1, 2, 3, 4, 4, 5, 5, 6] * 6:
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), f"t{i}", rng.random() < 0.2, rng.random() < 0.2)
                for i in range(n)]
        cost, audit, lines = brute(rows)
        pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        for most in (1, 2, 100):
            assert chained(rows, most, modulus) == (cost, audit, pairs, hashlib.sha256("\n".join(lines).encode()).hexdigest()), rows


def expected(rows):
    """The contract on (conv_id, turn, role, text) rows, with the brute search for the edits."""
    show = lambda v: " " if v is None else str(v)
    out, kept = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        kept[conv]
        draw = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        kept[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    for conv, found in kept.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, n, coded = set(), Counter(), []
        for turn, role, text in found:
            fault = ("blank" if not text.strip(WS) else "duplicate" if (role, text) in seen else
                     "truncated" if text.strip(WS)[-1] not in ".!?" else "")
            seen.add((role, text))
            n[fault] += 1
            coded.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        cost, audit, lines = brute(coded)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("most", [2, 20_000])
def test_repair_of_rows_with_nulls_ties_and_repeats(spark, most):
    rng = random.Random(12)
    texts = ["Yes.", "No!", "cut", " ", "", None, "ends. \n", "Why?", "long " * 3000 + "."]
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.randrange(1, 6)):
            row = (conv, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", None, "tool", ""]), rng.choice(texts))
            rows += [row] * rng.choice([1, 1, 1, 2])
    rows += [(100 + i, 0, "user", "Gone.") for i in range(60)]  # some lose their only row
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, key int")
    out = {r.conv_id: tuple(r)[1:] for r in repair(df, damage(df), most).collect()}
    want = expected(rows)
    assert out == want
    assert (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) in want.values()
    assert repair(df.limit(0), damage(df.limit(0))).count() == 0


def test_one_long_conversation_is_cut_into_pieces(spark):
    rng = random.Random(13)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Fine.", "open", "Why?"]) + str(rng.randrange(40)) + ".") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, parts = (repair(df, damage(df), m).first() for m in (20_000, 50))
    assert whole == parts and len(whole.audit) >= 2000


# ---------------------------------------------------------------- link trust
def walk(edges, seeds):
    """Whole-number personalised PageRank in plain Python."""
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    rank = dict(seeds)
    for _ in range(STEPS):
        new = Counter({h: m * 3 // 20 for h, m in seeds.items()})
        for (a, b), n in edges.items():
            new[b] += rank.get(a, 0) * 17 // (out[a] * 20) * n
        rank = new
    return rank


def test_judge_follows_rules_then_links(spark):
    rng = random.Random(14)
    hosts = [f"h{i}.test" for i in range(30)] + ["A.Good.test", "bad.test", "sub.bad.test"]
    rules = [("good.test/", "allow"), ("bad.test/", "block"), ("bad.test/fine/", "allow"), ("h1.test", "block"), ("h1.test/x", "allow")]
    pages, edges, seeds = [], Counter(), {"allow": Counter(), "block": Counter()}
    for i in range(400):
        host = rng.choice(hosts)
        path = rng.choice(["", "/", "/fine/a", "/x", "/fine"])
        targets = [rng.choice(hosts) for _ in range(rng.randrange(4))]
        forms = ['<a href="https://{0}/p?q">', "<A class=z HREF='//{0}'>", "<a href = http://{0}#f>x</a>"]
        html = "<p>" + "".join(rng.choice(forms).format(t) for t in targets) + '<a href="/own"><a name="z">'
        pages.append((i, f"https://{host}{path}?a=/b#c", html, "x"))
        low = host.lower()
        for t in targets:
            if t.lower() != low:
                edges[low, t.lower()] += 1
        fit = [(len(r), v) for r, v in rules
               if (low == r.split("/")[0] or low.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]):])]
        if fit:
            seeds[max(fit)[1]][low] += UNIT
    trust = walk(edges, seeds["allow"])
    distrust = walk({(b, a): n for (a, b), n in edges.items()}, seeds["block"])
    df = spark.createDataFrame(pages, "page_id long, url string, html string, mass string")
    verdicts = Counter()
    for r in judge(df, rules).collect():
        low = re.match("https://([^/?#]*)", pages[r.page_id][1])[1].lower()
        assert (r.host, r.trust, r.distrust) == (low, trust.get(low, 0), distrust.get(low, 0))
        if r.rule is None:
            assert r.verdict == ("block" if r.distrust > 2 * r.trust and r.distrust >= UNIT // 100 else "allow")
        else:
            assert dict(rules)[r.rule] == r.verdict
        verdicts[r.rule is None, r.verdict] += 1
    assert len(verdicts) == 4


def test_judge_edge_rows(spark):
    rows = [(1, None, None), (2, "no scheme", "<a href='//x.org/'>"), (3, "http://EXAMPLE.org/es/1?x", ""), (3, "http://EXAMPLE.org/es/1?x", ""),
            (None, "https://a.example.org", None), (5, "x://b.com/fr/é#y", "<a " * 3000), (6, "://org/", None), (7, "http://notorg/", None),
            (8, "http://example.org/en/19", None), (9, "http://" + "a." * 2000 + "org/en", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = sorted((tuple(r)[:5] for r in judge(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert out == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "example.org", "/es/1", "example.org/es/", "block"),
                   (3, "example.org", "/es/1", "example.org/es/", "block"), (5, "b.com", "/fr/é", "com/fr/", "allow"),
                   (6, "org", "/", "org/", "allow"), (7, "notorg", "/", None, "allow"), (8, "example.org", "/en/19", "example.org/en/1", "block"),
                   (9, "a." * 2000 + "org", "/en", "org/", "allow"), (None, "a.example.org", "", None, "allow")]
    assert judge(df.limit(0)).count() == 0


# ---------------------------------------------------------------- spelling forms
def spelled(rows):
    """The contract by brute force over all pairs of words."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))

    form, out = {}, {}
    for a in n:
        partners = [b for b in n if b != a and near(a, b)]
        best = min(partners, key=lambda b: (-n[b], b), default=None)
        form[a] = best if best and n[best] >= 5 * n[a] else None
        out[a] = [form[a], None, n[a], len(partners), n[best] if form[a] else None]
    for a in n:
        root = a
        while form[root]:
            root = form[root]
        out[a][1] = root
    return {a: tuple(v) for a, v in out.items()}


@pytest.mark.parametrize("filter_bytes", [64 << 20, 64])
def test_spelling_forms_equal_brute_force(spark, filter_bytes):
    """A bound of 64 bytes cuts the vocabulary into many slices, each with its own round."""
    rng = random.Random(16)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["ÿ" * 70, "z" * 65, "à" * 6]
    pool = []
    for s in stems:
        for _ in range(4):
            i, c = rng.randrange(len(s) + 1), rng.choice("abcéÉ÷z")
            pool += [s] * rng.choice([1, 5, 30]) + [rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1:], s[:i] + c + s[i + 1:]])]
    rows = [(i, " ".join(rng.choice(pool).capitalize() if rng.random() < 0.1 else rng.choice(pool) for _ in range(60))) for i in range(120)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (500, None), (501, ""), (502, "12 -- 34"), (503, "Q" * 5000 + " " + rows[1][1])]
    rows += [(600 + i, "k" * 30_000) for i in range(5)]  # a run longer than one batch of edits
    rows += [(700, "banana " * 200 + "bananaa " * 30 + "Bananaab " * 6)]  # forms of forms
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string")
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_forms(df, filter_bytes=filter_bytes).collect()}
    assert out == spelled(rows)
    assert sum(v[0] is not None for v in out.values()) > 10 and any(out[v[0]][0] for v in out.values() if v[0])
    assert spelling_forms(df.limit(0)).count() == 0


def test_every_edit_passes_the_filters_of_its_word():
    """Hashes of edits by prefix sums equal the hashes of the spelt words, so filters lose none."""
    import numpy as np

    from tidemark.llm.op13_spelling import ALPHABET, codes, edits, mixed, powers

    for word in ("banana", "éàüößxyz"):
        for length, h, _, at, letter in edits(codes([word], len(word)), 0, len(word), np.array(ALPHABET, np.uint64)):
            for got, p, c in zip(h.tolist(), at.tolist(), letter.tolist()):
                other = word[:p] + (chr(c) if c else "") + word[p + 1:]
                assert len(other) == length
                assert got == int(mixed((codes([other], length) * powers(length)[:length]).sum(axis=1, dtype=np.uint64))[0])


def test_new_queries_agree_with_their_sql(spark):
    import harness
    from tidemark.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = harness.duck(sf)
    for name in ("op11_conversation_repair", "op12_link_trust", "op13_spelling_forms"):
        r = harness.compare(spark, con, sf, name, QUERIES[name], ORACLES[name])
        assert r["ok"], r["why"]




# ---------------------------------------------------------------- edge rows of earlier operators
def test_merkle_takes_runs_of_any_length(spark):
    """End marks and white space in long runs, alone and among words."""
    from tidemark.llm.op04_merkle import likeness, merkle
    from tidemark.llm.op04_merkle import fingerprint as root

    texts = ["!" * 5000, "." * 4096, "a" + " " * 5000, "?" * 100_000, " " * 100_000, "a." + "\t" * 70_000 + "b", "Ok. " * 3000 + "!" * 50_000 + "\nEnd."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in merkle(df).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert out[i].n_chars == len(t) and out[i].fingerprint == root(t) and likeness(root(t), root(t)) == 1.0
        assert 0 <= out[i].near_edited <= 1 and root(t) != root(t + "!")


def test_toxicity_keeps_columns_named_like_its_own(spark):
    from tidemark.llm.common import table
    from tidemark.llm.op06_toxicity import score

    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    names = ["_fold", "_x", "x", "kept", "fold", "_features", "_raw", "_chance", "_calibrated", "toxic"]
    more = docs.selectExpr("*", *[f"doc_id + {i} AS `{n}`" for i, n in enumerate(names, 7)])
    out = score(more, labels)
    assert out.columns == [*more.columns, "held_out", "score", "predicted"]
    plain = {r.doc_id: r.score for r in score(docs, labels, keep=["doc_id"]).collect()}
    for r in out.collect():
        assert abs(r.score - plain[r.doc_id]) < 1e-9 and all(r[n] == r.doc_id + i for i, n in enumerate(names, 7))


def test_pipeline_stages_keep_columns_named_like_their_own(spark):
    import corpus_pipeline as p
    from tidemark.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents").selectExpr("*", *[f"doc_id AS `{n}`" for n in ("_row", "_copies", "_id", "_copy", "doc", "_copies_")])
    for name, stage in p.STAGES[1:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r["_row"] == r["_id"] == r["_copies"] == r.doc_id for r in rows), name
