import itertools
import math
import random
import time

import numpy as np
from llm_texts import prose

from cloakwork.llm import chat, langid, oracle, urlrules
from cloakwork.llm.neardup import mix64  # noqa: F401  shared hash

LANGS = {"aa": "bako dilu mane toro supi", "bb": "xyth qorv zwen klix fjor", "cc": "éàu ñoî üöä ßçê åøæ"}


def sentence(lang, r, n=60):
    syllables = LANGS[lang].split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_languages_and_mixtures(spark):
    r = random.Random(1)
    rows = [(i, sentence(lang := r.choice(list(LANGS)), r), lang) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.identify(docs).collect()}
    out = [got[i]["lang_pred"] == lang for i, _, lang in rows if got[i]["held_out"]]
    assert len(out) > 40 and np.mean(out) > 0.95
    langs, model = langid.learn(docs)
    (p,) = langid.mixtures([sentence("aa", r, 300) + " " + sentence("bb", r, 100)], model)
    assert abs(p[langs.index("aa")] - 0.75) < 0.1 and abs(p[langs.index("bb")] - 0.25) < 0.1 and p[langs.index("cc")] == 0
    (p,) = langid.mixtures([sentence("cc", r, 50)], model)
    assert p[langs.index("cc")] == 1


def test_languages_odd_rows(odd, none, spark):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(none).collect() == []
    unlabelled = odd.drop("lang").selectExpr("*", "cast(null as string) AS lang")
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


URLS = [
    "https://a.example.com/en/7x?q",
    "https://example.com/en/1",
    "http://EXAMPLE.net/de/8/",
    "http://x.net/de/#a",
    "http://net/de/",
    "http://org/es",
    "https://notcom/en/",
    "https://a.com/EN/",
    "no scheme com/en/",
    "",
    None,
    "x://y.org/es/?a=b://c.com/en/",
    "ftp://h?x/en/",
]


def brute_rule(u):
    if not u or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    h = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    p = rest[cut:]
    p = p[: min((p.find(c) for c in "?#" if c in p), default=len(p))]
    fits = [(len(a + b), v, a + b) for v, a, b in urlrules.FIXED if (h == a or h.endswith("." + a)) and p.startswith(b)]
    _, v, r = max(fits, default=(0, None, None))
    return h, p, r, v


def test_fixed_rules_equal_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    for r in urlrules.judge(pages, none).collect():
        h, p, rule, verdict = brute_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (h, p, rule, verdict or "allow")
    assert urlrules.judge(pages.limit(0), none).collect() == []


def test_fixed_rules_are_those_of_the_contract(spark):
    """The list is written out here, for the code, the SQL and the brute force above all read FIXED."""
    want = {
        "http://com/en/x": ("com/en/", "block"),
        "http://a.example.com/en/7x": ("example.com/en/7", "allow"),
        "http://net/de/": ("net/de/", "allow"),
        "http://EXAMPLE.net/de/7": ("net/de/", "allow"),
        "http://b.example.net/de/8/": ("example.net/de/8", "block"),
        "http://x.org/es/": ("org/es/", "block"),
        "http://x.org/de/": (None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlrules.judge(pages, none).collect()}
    assert got == dict(enumerate(want.values()))
    for rule, verdict in want.values():
        assert rule is None or f"{{'rule': '{rule}', 'verdict': '{verdict}'}}" in oracle.URLRULES


def test_rules_are_mined_and_pruned(spark):
    r = random.Random(4)
    rows = []
    for i in range(600):
        spam, shop = r.random() < 0.2, r.random() < 0.5
        host = "spam" if spam else r.choice("abcd")
        rows.append((i, f"http://{host}.site.io/{'shop' if shop else 'blog'}/{i}?ref=1", spam and shop))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(900, "http://spam.other.io/shop/x"), (901, "http://spam.site.io/blog/9"), (902, None), (None, "http://spam.x/shop"), (None, "http://spam.x/shop")], "page_id long, url string")
    pages = pages.selectExpr("*", "'x' AS token", "1 AS n", "2 AS id", "array(1) AS tokens")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows] + [(None, True), (3, None)], "page_id long, bad boolean")
    out = urlrules.judge(pages, labels).collect()
    got = {x["page_id"]: x["verdict"] for x in out}
    assert len(out) == 605 and [x["verdict"] for x in out if x["page_id"] is None] == ["block"] * 2
    assert all(got[i] == ("block" if b else "allow") for i, _, b in rows)
    assert got[900] == "block" and got[901] == "allow" and got[902] == "allow"
    tokens = urlrules.tokens
    labelled = pages.drop("tokens").join(labels, "page_id").select(tokens(pages.url, urlrules.host(pages.url), urlrules.path(pages.url)).alias("tokens"), "bad").where("bad is not null")
    assert [x["needs"] for x in urlrules.mine(labelled).collect()] == [[["h:spam"], ["p:shop"]]]


def wilson(hits, n, z=urlrules.QUANTILE):
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def brute_rules(rows, least, confidence):
    """Token sets with support, confidence and bound that no subset is as sure as."""
    base = sum(b for _, b in rows) / len(rows)
    sets = {s for t, b in rows if b for k in range(1, len(t) + 1) for s in itertools.combinations(sorted(t), k)}
    found = {}
    for s in sets:
        has = [b for t, b in rows if set(s) <= set(t)]
        if sum(has) >= least and sum(has) >= confidence * len(has) and wilson(sum(has), len(has)) > base:
            found[frozenset(s)] = sum(has) / len(has)
    return {s for s, c in found.items() if not any(x < s and d >= c for x, d in found.items())}


def test_rules_equal_brute_force(spark):
    r = random.Random(8)
    rows = []
    for _ in range(300):
        t = {x for x in "abcdef" if r.random() < 0.4}
        t |= {"g", "h"} if "a" in t else set()  # always with a
        rows.append((sorted(t), r.random() < (0.9 if {"a", "b"} <= t else 0.75 if "c" in t and "d" not in t else 0.2)))
    rows = [x for x in rows if x[0]]
    got = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), support=0.0, least=12).collect()
    got = {frozenset(s) for x in got for s in itertools.product(*x["needs"])}
    want = brute_rules(rows, 12, urlrules.CONFIDENCE)
    assert len(want) > 3 and {s for s in want if len(s) > 1} and got == want


def test_nearly_equal_rows_of_many_names(spark):
    """14 names that nearly always come together: every combination is a set, each looks at one less name."""
    r = random.Random(11)
    rows = []
    for i in range(200):
        names = [f"q:k{k:02}" for k in range(14) if r.random() < 0.95]
        rows.append((names or ["q:none"], i % 10 < 6))
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    urlrules.mine(df.limit(20), support=0.0).collect()  # compiles
    t = time.time()
    got = urlrules.mine(df, support=0.0).collect()
    assert time.time() - t < 30
    sets = {tuple(sorted(x for any_of in g["needs"] for x in any_of)): g["confidence"] for g in got}
    assert all(not (set(a) < set(b) and sets[a] >= sets[b]) for a in sets for b in sets)
    assert all(abs(c - (lambda has: sum(has) / len(has))([b for t, b in rows if set(s) <= set(t)])) < 1e-9 for s, c in sets.items())


def test_tokens_that_always_come_together(spark):
    tail = "&".join(f"k{i}=1" for i in range(30))
    pages = spark.createDataFrame([(i, f"http://h{i}.io/p?{tail}" if i % 2 else f"http://h{i}.io/q?z=1") for i in range(400)] + [(999, "http://new.org/x?k7=2"), (1000, "http://a.io/" + "b/" * 20_000)], "page_id long, url string")
    labels = spark.range(400).selectExpr("id AS page_id", "id % 2 = 1 AND id % 9 <> 0 AS bad")
    got = {x["page_id"]: x["verdict"] for x in urlrules.judge(pages, labels).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(400)) and got[999] == "block" and got[1000] == "allow"


def talk(n, seed):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(2, 6)):
            role = "assistant" if t % 2 else "user"
            lines = r.randint(2, 5) if t % 2 else 1
            text = "\n".join(prose(r.random(), 40 if t % 2 else 6).replace("\n", " ") for _ in range(lines))
            rows.append((c, t, role, text + ("?" if t % 2 == 0 else ".")))
    return rows


def test_roles_are_recovered(spark):
    rows = talk(120, 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in chat.parse(df.drop("role"), chat.learn(df)).collect()}
    hits = [got.get((c, t)) is not None and got[c, t]["role"] == role for c, t, role, _ in rows]
    assert np.mean(hits) > 0.95
    assert all(r["rendered"].startswith(f"<|{r['role']}|>\n") and r["rendered"].endswith("\n<|end|>\n") for r in got.values())


def test_markers_tell_roles_in_one_text(spark):
    df = spark.createDataFrame([(1, 0, "User: hello there\nmore of it\nAssistant: yes\nno\nHuman: and?\n")], "conv_id long, turn long, text string")
    got = chat.parse(df, chat.Model({})).collect()
    assert [(r["role"], r["lines"]) for r in got] == [("user", 2), ("assistant", 2), ("user", 1)]
    assert got[0]["rendered"] == "<|user|>\nhello there\nmore of it\n<|end|>\n"


def test_viterbi_equals_brute_force():
    r = np.random.default_rng(5)
    model = chat.Model({(str(k), s, f): float(r.random() * 20) for k, n in enumerate(chat.SIZES) for s in range(len(chat.STATES)) for f in range(n)})
    for _ in range(5):
        f = [tuple(int(r.integers(n)) for n in chat.SIZES) for _ in range(5)]
        states, _ = model.decode(f)

        def score(p, f=f):
            s = model.start[p[0]] + sum(model.move[a, b] for a, b in zip(p, p[1:]))
            return s + sum(model.emit[k][q, x] for q, fx in zip(p, f) for k, x in enumerate(fx))

        best = max(itertools.product(range(len(chat.STATES)), repeat=5), key=score)
        assert abs(score(best) - score(states)) < 1e-9


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, "user"), (1, 0, "", "user"), (None, None, "a\n\nb", None), (None, None, None, None), (2, 10**9, "x " * 100_000, "user"), (2, None, "y", "system")] + [(3, 0, "same", "user")] * 9000
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, text string, role string, block string, lines int")
    got = chat.parse(df, chat.learn(df)).collect()
    assert sum(r["lines"] for r in got if r["conv_id"] == 3) == 9000
    assert chat.parse(df.limit(0), chat.Model({})).collect() == []


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(i, prose(i, 5), f"l{i}") for i in range(210)], "doc_id long, text string, lang string")
    assert len(langid.learn(docs)[0]) == 210


def test_mixture_equals_brute_force():
    """The same model in plain Python: EM over all languages, then nested sets."""
    r = random.Random(6)
    langs = ["aa", "bb", "cc", "dd"]
    known = {**LANGS, "dd": "wub pok rij nux glo"}
    model = np.full((langid.BUCKETS, 4), langid.SMOOTH)
    for i, lang in enumerate(langs):
        for _ in range(50):
            syllables = known[lang].split()
            np.add.at(model[:, i], langid.features(" ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(60))), 1)
    model = (model / model.sum(0)).astype(np.float32)

    def text(*parts):
        return " ".join("".join(r.choice(known[lang].split()) for _ in range(2)) for lang, n in parts for _ in range(n))

    texts = [text(("aa", 80)), text(("aa", 50), ("dd", 90)), text(("aa", 60), ("bb", 60), ("cc", 60)), text(("aa", 60), ("bb", 70), ("cc", 80), ("dd", 90)), "x", text(("bb", 3)), ""]
    texts += texts[:2]  # repeated rows

    def em(f, allowed, steps):
        p = {i: 1 / len(allowed) for i in allowed}
        for _ in range(steps):
            new = dict.fromkeys(allowed, 0.0)
            for b in f:
                s = sum(float(model[b, i]) * p[i] for i in allowed)
                for i in allowed:
                    new[i] += float(model[b, i]) * p[i] / s / len(f)
            p = new
        return p, sum(math.log(sum(float(model[b, i]) * p[i] for i in allowed)) for b in f)

    sizes = []
    for t, q in zip(texts, langid.mixtures(texts, model)):
        f = langid.features(t).tolist()
        if not f:
            assert q is None
            continue
        p, _ = em(f, range(4), langid.STEPS)
        order = sorted(range(4), key=lambda i: -p[i])
        best, want = -math.inf, None
        for k in range(1, 5):
            p, fit = em(f, order[:k], 0 if k == 1 else langid.STEPS)
            fit -= k * langid.PENALTY * math.log(max(len(f), 2))
            if fit <= best:
                break
            best, want = fit, p
        sizes.append(len(want))
        assert all(abs(q[i] - want.get(i, 0.0)) < 1e-3 for i in range(4))
    assert sizes[:4] == [1, 2, 3, 4]


def test_long_conversation_equals_whole_viterbi(spark, monkeypatch):
    rows = [(7, t, role, text) for t, (_, _, role, text) in enumerate(talk(12, 3))] + [(8, t, "user", "a\nb") for t in range(3)]
    model = chat.learn(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    monkeypatch.setattr(chat, "BLOCK", 3)
    df = spark.createDataFrame([(c, t - 5, r, x) for c, t, r, x in rows], "conv_id long, turn long, role string, text string")
    again = chat.learn(df)
    assert np.array_equal(model.start, again.start) and np.array_equal(model.move, again.move) and all(map(np.array_equal, model.emit, again.emit))
    for m in (model, chat.Model({("1", 0, 1): 5.0, ("move", 0, 1): 90.0, ("move", 1, 1): 90.0})):
        want = []
        for c in (7, 8):
            lines = chat.lines_of([(t - 5, x, None) for d, t, _, x in rows if d == c])
            want += [(c, t, chat.ROLES[r], len(x), chat.render(chat.ROLES[r], x)) for _, t, r, x in chat.turns_of(lines, m, -1, -1)]
        got = [(r["conv_id"], r["turn"], r["role"], r["lines"], r["rendered"]) for r in chat.parse(df.drop("role"), m).collect()]
        assert sorted(got) == sorted(want)
