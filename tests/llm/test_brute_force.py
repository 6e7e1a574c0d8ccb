"""Whole results of operators and of the pipeline against plain versions, row by row."""

import collections
import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodestone.llm import _spans, _text, decontamination, packing, quality_classifier, quality_rules, substring_parse, token_counts, toxicity, url_filters
from lodestone.llm._tables import table

from test_llm_operators import BPE, WORD, _components, _counts, _documents, _packed, _set, _without_repeated_lines, _without_repeats

MARKS = "!?.,;:-_=~/\\\"'()[]{}@^`+"


def _features(t):
    """The statistics of the quality rules, by their names."""
    t = t or ""
    words, symbols = WORD.findall(t), "#*$%&|<>"
    n_words, chars, n_symbols, dup, repeats = _counts(t)
    lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
    some, top = max(n_words, 1), collections.Counter(words).most_common(1)
    size = lambda w: len(w.encode())
    return {
        "log_words": math.log1p(n_words), "chars_per_word": chars / some, "symbols_per_word": n_symbols / some, "dup_line_share": dup / max(lines, 1),
        "repeat_share": repeats / some, "upper_share": sum("A" <= c <= "Z" for c in t) / max(chars, 1), "digit_share": sum("0" <= c <= "9" for c in t) / max(chars, 1),
        "mark_share": sum(c in MARKS for c in t) / some, "distinct_share": len(set(words)) / math.sqrt(some), "words_per_line": n_words / max(lines, 1),
        "top_word_share": (top[0][1] if top else 0) / some, "symbol_word_share": sum(any(c in symbols for c in w) for w in words) / some,
        "long_word_share": sum(size(w) > 24 for w in words) / some, "shout_share": sum(sum("A" <= c <= "Z" for c in w) >= 2 for w in words) / some,
    }


def _walked(model, x):
    """The probability of label 1, tree by tree and node by node."""
    margin = model.bias
    for feature, threshold, left, right, value in zip(model.feature, model.threshold, model.left, model.right, model.value):
        node = 0
        while left[node] != node:
            node = left[node] if x[feature[node]] <= threshold[node] else right[node]
        margin += value[node]
    return 1 / (1 + math.exp(-min(max(margin, -50), 50)))


def _kept_by_rules(model, t):
    n, *_, repeats = _counts(t)
    f = _features(t)
    return not (n < 50 or 100 * repeats > 50 * n) and _walked(model, [f[k] for k in quality_rules.FEATURES]) >= 0.5


def test_quality_rules(spark, data, odd, frame):
    docs, labels = table(spark, data, "documents", "doc_id", "text"), table(spark, data, "labels", "doc_id", "quality")
    model = quality_rules.train(docs, labels)
    assert len(model.value)
    for rows, texts in ((quality_rules.assess(docs, model), _documents(spark, data).values()), (quality_rules.assess(frame(odd), model), [t for _, t in odd])):
        got = sorted((r["n_words"], r["word_chars"], r["kept"]) for r in rows.collect())
        assert got == sorted((_counts(t)[0], _counts(t)[1], _kept_by_rules(model, t)) for t in texts)
    score = {r["doc_id"]: r["score"] for r in quality_rules.assess(docs, model).collect()}
    for i, t in _documents(spark, data).items():
        f = _features(t)
        assert score[i] == pytest.approx(_walked(model, [f[k] for k in quality_rules.FEATURES]), abs=1e-9)


def _distance(a, b):
    """Edits between two words; a swap of neighbours that alone makes them equal is one."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = i - 1, i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    swapped = any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))
    return min(row[-1], 1) if swapped and len(b) >= 4 else row[-1]


def _weight(model, word):
    """(weight, edits) of a word by comparing it with every lexicon word and stem, or None."""
    w, best, edits = toxicity.norm(word), None, 0
    if len(w) < toxicity.SHORTEST:
        return None
    if w in model.words:
        best = model.words[w]
    elif w not in model.plain:
        near = [(d, -model.words[x]) for x in model.words if abs(len(x) - len(w)) <= 2 and (d := _distance(w, x)) <= toxicity.Automaton.edits(x)]
        if near:
            edits, minus = min(near)
            best = -minus * toxicity.MISSPELT
    if best is None or edits:
        stems = [model.stems[w[:k]] for k in toxicity.STEMS if w[:k] in model.stems]
        if stems and (best is None or max(stems) > best):
            best, edits = max(stems), 0
    return None if best is None else (best, edits)


def test_toxicity(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = table(spark, data, "documents", "doc_id", "text"), table(spark, data, "labels", "doc_id", "toxic")
    model = toxicity.train(docs, labels)
    assert model.words and len(model.trees.value)
    score = {r["doc_id"]: r["score"] for r in toxicity.assess(docs, model).collect()}
    known: dict = {}
    for i, t in sorted(_documents(spark, data).items())[:250]:
        words = (t or "").split()
        for w in words:
            if w not in known:
                known[w] = _weight(model, w)
        own = {w: known[w] for w in set(words) if known[w] is not None}
        stem = {w: max(((model.pairs[k], k) for j in toxicity.STEMS if (k := toxicity.norm(w)[:j]) in model.pairs), default=None) for w in set(words)}
        often = collections.Counter(stem[w] for w in words)
        for w, k in stem.items():
            if k is not None and often[k] > 1 and (w not in own or own[w][0] < k[0]):
                own[w] = (k[0], 0)
        places = [p for p, w in enumerate(words) if w in own]
        x = [0.0] * toxicity.FEATURES
        if places:
            quoted = dict(zip(places, toxicity._quoted(words, places)))
            effect = {p: own[words[p]][0] * (toxicity.QUOTED if quoted[p] else 1.0) for p in places}
            exact = [effect[p] for p in places if not own[words[p]][1]]
            best = 0.0
            for p in places:
                near = range(p - toxicity.WINDOW, p + toxicity.WINDOW + 1)
                inside = sum(effect.get(q, 0.0) for q in near)
                address = any(toxicity.norm(words[q]) in toxicity.ADDRESS for q in near if 0 <= q < len(words))
                best = max(best, inside * (1.5 if address and not quoted[p] else 1.0))
            total = sum(effect.values())
            x = [total, total / math.sqrt(len(words) + 10), best, float(len({words[p] for p in places})), total / len(words), max(effect.values()), sum(exact), max(exact, default=0.0)]
        assert score[i] == pytest.approx(_walked(model.trees, x), abs=1e-6), i


def test_quality_classifier(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = table(spark, data, "documents", "doc_id", "text"), table(spark, data, "labels", "doc_id", "quality")
    space = quality_classifier.train(docs, labels)
    score = {r["doc_id"]: r["score"] for r in quality_classifier.assess(docs, space).collect()}
    vectors = space.vectors.astype(float)
    for i, t in sorted(_documents(spark, data).items())[:200]:
        block = next(_text.blocks(pa.array([t or ""])))
        counts, shape = quality_classifier.raw_counts(block)
        raw = (t or "").encode()
        assert counts[0].sum() == max(0, len(raw) - 2) + len(WORD.findall(t or ""))
        v = space.project(space.terms(counts, shape))[0].astype(float)
        votes = sorted(((float(v @ w), y, s) for w, y, s in zip(vectors, space.labels, space.vote)), reverse=True)[:15]
        weight = [max(c, 1e-6) ** 8.0 * s for c, _, s in votes]
        assert score[i] == pytest.approx(sum(w * y for w, (_, y, _) in zip(weight, votes)) / sum(weight), abs=1e-3)


def _local_score(a, b):
    """The best local alignment of two lists of words, cell by cell: 2 for equal words, -1 for others and for gaps."""
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for k, y in enumerate(b):
            now.append(max(0, before[k] + (2 if x == y else -1), before[k + 1] - 1, now[k] - 1))
        best, before = max(best, max(now)), now
    return best


def _contaminated(docs, items):
    """(doc, item) of which the words align anywhere in the document, all pairs."""
    number: dict = collections.defaultdict(lambda: len(number))
    split = re.compile(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+")
    words = lambda t: np.array([number[w] for w in split.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))], np.int64)
    own = {i: words(t) for i, t in items}
    out = set()
    for d, t in docs:
        text = words(t)
        for i, item in own.items():
            # only equal words add to a score
            if len(item) >= 5 and np.isin(text, item).sum() >= decontamination.THRESHOLD * len(item) and _local_score(item.tolist(), text.tolist()) >= decontamination.THRESHOLD * 2 * len(item):
                out.add((d, i))
    return out


def test_seed_recall_over_all_pairs(spark, data):
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.query(spark, data).collect()}
    want = _contaminated(_documents(spark, data).items(), table(spark, data, "benchmark", "item_id", "text").collect())
    assert want and found == want


def test_item_ids_of_any_type(spark, frame):
    item = " ".join(f"w{i}" for i in range(12))
    docs = frame([(1, "before " + item + " after")])
    for kind, value in (("string", "a"), ("int", 7), ("short", 7), ("double", 1.5)):
        bench = spark.createDataFrame([(value, item)], f"item_id {kind}, text string")
        assert [r["item_id"] for r in decontamination.contaminated(docs, bench).collect()] == [value]


def test_pipeline(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    model = quality_rules.train(table(spark, data, "documents", "doc_id", "text"), table(spark, data, "labels", "doc_id", "quality"))
    docs = {i: t for i, t in docs.items() if _kept_by_rules(model, t)}
    component = _components(docs.items())
    docs = {i: t for i, t in docs.items() if component[i] == i}
    cut = _without_repeated_lines([(i, t or "") for i, t in docs.items()])
    docs = {i: cut[i] for i in docs if WORD.search(cut[i]) or cut[i] == docs[i]}
    leaks = {d for d, _ in _contaminated(docs.items(), table(spark, data, "benchmark", "item_id", "text").collect())}
    docs = {i: t for i, t in docs.items() if i not in leaks}
    assert docs and leaks
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set()
    for i, t in docs.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = len(ids) - 2048 * ((len(ids) - 1) // 2048)
        for piece, (a, z) in enumerate([(0, at), *((x, x + 2048) for x in range(at, len(ids), 2048))]):
            want.add((i, piece, a, z - a, zlib.crc32(ids[a:z].tobytes())))
    rows = corpus_pipeline.run(spark, data).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    assert len(_packed(rows, 2048)) <= -(-sum(x[3] for x in want) // 2048) + 1


def test_suffix_order():
    r = random.Random(1)
    for length in (8, 9, 23, 100, 101):
        for letters in (b"ab", bytes(range(250, 256)), bytes(range(256))):
            raw = bytes(r.choice(letters) for _ in range(1200)) + b"a" * 400
            start = np.array(r.sample(range(len(raw) - length + 1), 600))
            order, interval = substring_parse.suffix_order(np.frombuffer(raw, np.uint8), start, length)
            own = [raw[s : s + length] for s in start[order]]
            assert own == sorted(own)
            assert interval.tolist() == np.cumsum([0, *(x != y for x, y in zip(own, own[1:]))]).tolist()


def test_full_bitmap_changes_no_result(spark, frame, monkeypatch):
    r = random.Random(4)
    passage = "".join(r.choice("abcdef ") for _ in range(200))
    rows = [(i, "".join(r.choice("abcdef ") for _ in range(150)) + passage * (i % 2)) for i in range(400)]
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    for words in (1, 8, 1 << 10):
        monkeypatch.setattr(_spans, "_WORDS", words)
        got = {x["doc_id"]: tuple(x[c] for c in columns) for x in substring_parse.remove_repeats(frame(rows)).collect()}
        assert got == _without_repeats(rows)


def test_long_words_compose(monkeypatch):
    from tokenizers import Tokenizer

    library, r = Tokenizer.from_file(BPE), random.Random(3)
    monkeypatch.setattr(token_counts.Transducer, "CHUNK", 5)
    with open(BPE, "rb") as f:
        counter = token_counts.Counter(f.read(), token_counts.character_classes(library.pre_tokenizer))
    texts = ["".join(r.choice(["a", "b", "the", "ing", "Str", "é", "日"]) for _ in range(r.randrange(200))) for _ in range(300)] + ["x" * 5000, "ab" * 3000, "=" * 777]
    assert counter(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pairs_that_stay_apart():
    with open(BPE, "rb") as f:
        v = token_counts.Vocabulary(f.read())
    transducer, r = token_counts.Transducer(v), random.Random(5)
    ids = sorted(i for i in v.bytes_of if len(v.bytes_of[i]) < 8)
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(3000)]
    for (left, right), (_, out) in r.sample(sorted(v.rank.items()), 1500):
        pairs += [(left, right), (out, out), (left, out), (out, right), (left, r.choice(ids)), (r.choice(ids), right)]
    for a, b in pairs:
        assert transducer._apart(a, b) == (v.encode(v.bytes_of[a] + v.bytes_of[b]) == [a, b]), (a, b)


def test_tightest_limits_cost_no_sequence():
    r = random.Random(9)
    lengths = collections.Counter(r.randrange(1, 100) for _ in range(4000))
    documents, cost = packing.tightest(lengths, 128)
    _, need = packing.plan(lengths, 128)
    rows, n = packing.plan(lengths, 128, documents, cost)
    assert n == need == -(-sum(k * v for k, v in lengths.items()) // 128)
    assert documents < 128 and cost < 128**2
    assert packing.plan(lengths, 128, documents // 2)[1] > need and packing.plan(lengths, 128, documents, cost - 128**2 // 16)[1] > need
    assert packing.tightest({}, 128)[0] == 1 and packing.tightest({128: 3}, 128) == (1, 128**2)


def test_rules_from_a_table(spark):
    rows = [("prefix", "com/en/", "block"), ("host", "spam-farm", "block"), ("path", "cgi-bin", "block"), ("regex", "/tag/[^/]+/page/[0-9]+", "block"), ("regex", "^m[.](a|b)[.]", "allow"), (None, "x", "block")]
    rules = url_filters.rules_of(spark.createDataFrame(rows, "kind string, pattern string, verdict string"))
    assert {r.pattern: r.tokens for r in rules if r.name.startswith("/tag")} == {"(?s)/tag/[^/]+/page/[0-9]+": ("tag", "page")}
    assert url_filters.literal_tokens("ab/cd/(e|f)g/hi") == ("cd",) and url_filters.literal_tokens("(?i)/ab/") == ()
    r = random.Random(2)
    part = ["www", "spam-farm", "spam-farms", "com", "m", "a", "b", "c", "cgi-bin", "tag", "x", "page", "7", "en", "CGI-bin"]
    urls = ["http://" + ".".join(r.choice(part) for _ in range(3)) + "".join("/" + r.choice(part) for _ in range(r.randrange(6))) for _ in range(600)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in url_filters.filter_urls(pages, rules).collect()}
    joined = {x["page_id"]: (x["rule"], x["verdict"]) for x in url_filters.by_join(pages, rules).collect()}
    for i, u in enumerate(urls):
        host, slash, path = u[7:].partition("/")
        hits = [x for x in url_filters._ranked(rules) if re.search(x.pattern, host + slash + path)]
        want = (hits[0].name if hits[0].named else None, hits[0].verdict) if hits else (None, "allow")
        assert got[i] == joined[i] == want


def test_ids_with_several_texts(spark, frame):
    from lodestone.llm import near_dedup

    r = random.Random(21)
    say = lambda n: [f"z{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for n in range(12):
        base = say(110)
        for k in range(6):
            own = list(base)
            for _ in range(3):
                own[r.randrange(110)] = f"y{r.randrange(10**6)}"
            rows.append((100 * n + k, " ".join(own)))
        rows.append((100 * n + 3, " ".join(say(500))))
        rows.append((100 * n + 50, " ".join(base[:60] + say(60))))
    assert all(_set(t) for _, t in rows)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(frame(rows)).collect()}
    assert got == _components(rows)


def test_more_rules_than_the_constant_holds(spark):
    """Over ``MOST_RULES`` rules go through the join inside ``filter_urls``; each URL's verdict is that of its longest rule."""
    r = random.Random(21)
    hosts = [f"h{k}.{top}" for k in range(3000) for top in ("com", "net")]
    rows = {(h, f"/{'/'.join(str(r.randrange(4)) for _ in range(r.randint(0, 3)))}/".replace("//", "/")): r.choice(("allow", "block")) for h in hosts for _ in range(6)}
    assert len(rows) > url_filters.MOST_RULES
    table_ = spark.createDataFrame([("prefix", h + p, v) for (h, p), v in rows.items()], "kind string, pattern string, verdict string")
    urls = [f"https://{r.choice(('', 'www.', 'a.b.'))}{r.choice(hosts)}/{'/'.join(str(r.randrange(4)) for _ in range(r.randint(0, 4)))}?q" for _ in range(400)] + ["http://h1.com/"] * 50
    pages = spark.createDataFrame(list(enumerate([*urls, None, "h1.com/"])), "page_id long, url string")
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in url_filters.filter_urls(pages, url_filters.rules_of(table_)).collect()}
    assert len(got) == len(urls) + 2
    for i, url in enumerate(urls):
        host, path = re.match(r"https?://([^/?]*)([^?]*)", url).groups()
        names = [host[k:] for k in range(len(host)) if k == 0 or host[k - 1] == "."]
        fits = [(len(h + p), h + p, rows[h, p]) for h in names for n in range(len(path) + 1) for p in [path[:n]] if (h, p) in rows]
        assert got[i] == ((max(fits)[1], max(fits)[2]) if fits else (None, "allow"))
    assert got[len(urls)] == got[len(urls) + 1] == (None, "allow")
