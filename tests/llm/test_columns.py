"""Native operators: URL filters, sharding, quality rules, chat formatting, source mixing."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliospark.llm import chat, mixing, quality, sharding, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string"


@pytest.fixture
def odd_docs(table):
    """Nulls in every column, empty and long texts, ties and repeated rows, and a clashing extra column."""
    rows = [
        (1, None, "en", "a", None, "x"),
        (2, "", None, None, 0, None),
        (3, "one two three", "en", None, 3, "x"),
        (3, "one two three", "en", None, 3, "x"),
        (None, "one two three", None, "b", 3, "x"),
        (5, "word " * 30_000, "de", "b", 1, "x"),
        (6, " \n\t ", "de", "b", 1, "x"),
    ]
    return table(rows, DOCS)


# -- URL filters ------------------------------------------------------------------------------------------------------


def test_url_parts(spark):
    rows = spark.createDataFrame([("HTTP://u:p@WWW.Ex.com:80/a/b/?q#f",), ("notaurl",), (None,), ("https://10.0.0.1/x",)], "url string")
    got = [r["r"] for r in rows.select(url_filters.rules_of(url_filters.F.col("url")).alias("r")).collect()]
    assert {x["rule"] for x in got[0]} == {"domain:www.ex.com", "domain:ex.com", "host:www.ex.com", "url:www.ex.com/a/b"}
    assert got[1] == [] and got[2] == []
    assert {x["rule"] for x in got[3]} == {"host:10.0.0.1", "url:10.0.0.1/x"}


def test_entries_by_brute_force(spark):
    rng = random.Random(5)
    day = lambda n: f"2024-{1 + n // 28:02d}-{1 + n % 28:02d}"
    hosts = ["a.x.com", "b.x.com", "x.com", "y.org"]
    rules = ["domain:x.com", "domain:b.x.com", "host:a.x.com", "url:y.org/p", "domain:y.org"]
    entries = [(rng.choice(rules), day(rng.randrange(300)), rng.choice(url_filters.ACTIONS), rng.choice([None, day(rng.randrange(300))])) for _ in range(60)]
    captures = [(i, f"http://{rng.choice(hosts)}/p", day(rng.randrange(320)), "mine") for i in range(200)] + [(900, None, day(3), None), (901, "http://x.com", None, None)]
    listed = spark.createDataFrame(entries, "rule string, listed string, action string, until string")
    seen = spark.createDataFrame(captures, "id long, url string, fetched string, rule string")
    got = {r["id"]: (r["action"], r["rule"], r["kept"]) for r in url_filters.filter_urls(seen, listed).collect()}
    for i, url, fetched, _ in captures:
        best = None
        if url and fetched:
            host = url.split("/")[2]
            own = [(1_000_001, f"url:{host}/p"), (1_000_000, f"host:{host}")]
            parts = host.split(".")
            own += [(len(parts) - k, "domain:" + ".".join(parts[k:])) for k in range(len(parts) - 1)]
            for rank, rule in own:
                past = [e for e in entries if e[0] == rule and e[1] <= fetched]
                if past:
                    last = max(e[1] for e in past)
                    top = max((e for e in past if e[1] == last), key=lambda e: (url_filters.ACTIONS.index(e[2]), e[3] or "9"))
                    if top[2] != "remove" and (top[3] is None or fetched <= top[3]):
                        best = max(best or (0,), (rank, top[2], rule))
        assert got[i] == ((best[1], best[2], best[1] != "block") if best else (None, None, True)), i


def test_no_entries(spark):
    seen = spark.createDataFrame([(1, "http://x.com", "2024-01-01")], "id long, url string, fetched string")
    none = spark.createDataFrame([], "rule string, listed string, action string, until string")
    assert url_filters.filter_urls(seen, none).collect()[0]["kept"]
    assert url_filters.filter_urls(seen.limit(0), none).count() == 0


# -- sharding ---------------------------------------------------------------------------------------------------------


def test_runs_equal_single_steps():
    rng = random.Random(2)
    for _ in range(40):
        runs = sorted({rng.randrange(1, 400): rng.randrange(1, 200) for _ in range(8)}.items(), reverse=True)
        n = rng.choice([1, 3, 40])
        loads, heap = [0] * n, [(0, i) for i in range(n)]
        for weight, count in runs:
            assert sum(sharding.lay_run(loads, weight, count)) == count
            for _ in range(count):
                x, i = heapq.heappop(heap)
                heapq.heappush(heap, (x + weight, i))
        assert sorted(loads) == sorted(x for x, _ in heap)


def test_shards(spark, odd_docs):
    rng = random.Random(3)
    many = spark.createDataFrame([(i, "t" * rng.choice([5, 50, 500, rng.randrange(2000)]) + str(i % 90)) for i in range(400)], "doc_id long, text string")
    for docs in (many, odd_docs):
        rows = docs.select("doc_id", "text").collect()
        got = sharding.shard(docs, 7).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
        by_shard, loads, shards_of = defaultdict(list), Counter(), defaultdict(set)
        for r in got:
            by_shard[r["shard"]].append(r["slot"])
            loads[r["shard"]] += r["size"]
            shards_of[r["text_crc32"], r["size"]].add(r["shard"])
        assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
        groups = Counter()
        for r in rows:
            groups[r["text"]] += 16 + len((r["text"] or "").encode())
        heap = [(0, i) for i in range(7)]
        for w in sorted(groups.values(), reverse=True):
            x, i = heapq.heappop(heap)
            heapq.heappush(heap, (x + w, i))
        assert sorted(loads[i] for i in range(7)) == sorted(x for x, _ in heap)
        assert all(len(s) == 1 for (crc, size), s in shards_of.items() if size > 16)
        assert {r["text_crc32"] for r in got} == {zlib.crc32((r["text"] or "").encode()) for r in rows}
    assert sharding.shard(many.limit(0), 7).count() == 0


# -- quality ----------------------------------------------------------------------------------------------------------


def plain_stats(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = Counter(grams)
    covered = {j for i, g in enumerate(grams) if twice[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark, odd_docs):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", " ", "\n", "#", "é", "\x0b", " ", "🎉 ", "a b c "]) for _ in range(rng.randrange(80))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for got in quality.base_stats(docs).collect() + quality.base_stats(odd_docs.drop("shard")).collect():
        assert tuple(got[c] for c in quality.STATS) == plain_stats(got["text"]), got["text"][:80]


def plain_mcd(points):
    """The estimate of one group, step by step with numpy."""
    x = np.array(points, float)
    floor = np.array(quality.FLOORS) * quality.SCALE
    mean = np.median(x, axis=0)
    cov = np.diag(np.maximum(np.median(abs(x - mean), axis=0) * 1.4826, floor) ** 2)
    for _ in range(quality.STEPS):
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        bins = np.floor(np.log(1 + d2) * quality.BINS)
        order = np.sort(bins)
        top = max(b for b in set(bins) if (order < b).sum() < quality.KEEP_SHARE * len(x))
        near = x[bins <= top]
        mean = near.mean(0)
        cov = quality.SPREAD * (near.T @ near / len(near) - np.outer(mean, mean))
        for i in range(quality.D):  # lengths get the floor added, rates have it as a least variance
            cov[i, i] = cov[i, i] + floor[i] ** 2 if i < quality.ADDED else max(cov[i, i], floor[i] ** 2)
    return mean, np.linalg.inv(cov)


def test_verdicts_by_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(rng.randrange(20, 400))]
        if i % 29 == 0:
            words = [w + "###" for w in words]
        elif i % 3:  # rates vary: symbols, repeated lines and repeated words, some of each
            words = [w + "#" * (rng.random() < (i % 7) / 40) for w in words]
            words += words[: rng.randrange(len(words) // 3 + 1)]
            if i % 2:
                lines = [" ".join(words[k : k + 6]) for k in range(0, len(words), 6)]
                words = ["\n".join(lines + lines[: i % 5])]
        rows.append((i, " ".join(words), "en" if i % 2 else None, rng.choice(["big", "big", "big", "small"]) if i < 390 else f"s{i}", "extra"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    points, groups, wide = {}, defaultdict(list), defaultdict(list)
    for i, text, lang, source, _ in rows:
        n, chars, symbols, dup, rep = plain_stats(text)
        assert got[i]["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        if not got[i]["base_failed"]:
            raw = [math.log(1 + n), math.log(max(chars, 1) / n)] + [math.log(1 + 100 * c / n) for c in (symbols, dup, rep)]
            points[i] = [math.floor(v * quality.SCALE + 0.5) for v in raw]
            groups[lang, source].append(i)
            wide[lang].append(i)
    for i, _, lang, source, _ in rows:
        if i in points:
            own = groups[lang, source] if len(groups[lang, source]) >= quality.MIN_GROUP else wide[lang]
            mean, inverse = plain_mcd([points[k] for k in own])
            z = np.array(points[i]) - mean
            assert got[i]["distance2"] == pytest.approx(z @ inverse @ z, rel=1e-6)
            assert got[i]["kept"] == (got[i]["distance2"] <= quality.CUTOFF)
        else:
            assert not got[i]["kept"]
    assert not any(got[i]["kept"] for i in range(0, 400, 29))
    assert sum(r["kept"] for r in got.values()) > 250
    spread = [len({p[i] for p in points.values()}) for i in range(quality.D)]
    assert min(spread) > 50  # every statistic varies, so the brute force checks its floor


def test_moderate_outliers_go_and_clean_texts_stay(spark):
    """Each rate rejects by itself, far below half of the words, and a little of each is no outlier."""
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choices("abcdefghijkl", k=rng.randrange(3, 9))) for _ in range(n)]

    def prose(n):
        w = words(n)
        return "\n".join(" ".join(w[i : i + 10]) for i in range(0, n, 10))

    clean = [prose(rng.randrange(150, 500)) for _ in range(200)]
    again, few = " ".join(words(65)), " ".join(words(9))
    lines = [words(1)[0] for _ in range(40)]
    planted = {
        "repeated windows": f"{prose(170)}\n{again} {again}",
        "repeated lines": prose(180) + "".join(f"\n{w}\n{x}\n{w}" for w, x in zip(lines, words(40))),
        "half and lines": "\n".join([*words(60), prose(90), *([" ".join(words(3))] * 30)]),
        "symbols": prose(300).replace(" ", " # ", 60),
    }
    slight = {"one line twice": f"{prose(290)}\n{few}\n{few}", "few symbols": prose(300).replace(" ", " # ", 4)}
    texts = [*planted.values(), *slight.values(), *clean]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, name in enumerate(planted):
        assert not got[i]["base_failed"] and not got[i]["kept"], (name, got[i]["distance2"])
    assert all(got[i]["kept"] for i in range(len(planted), len(texts)))


def test_quality_of_odd_rows(odd_docs):
    got = quality.judge(odd_docs)
    assert got.count() == 7 and not any(r["kept"] for r in got.collect())
    assert quality.judge(odd_docs.limit(0)).count() == 0


# -- chat -------------------------------------------------------------------------------------------------------------


def test_escapes_are_reversible(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["<", "\\", "|", "im_end", "|>", "x", "\n", "$1", "im_start"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = [(i, [{"role": rng.choice(["user", "assistant", "to\nol", "a\\n", "\\\\n<|"]), "text": t}] * 2) for i, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id long, turns array<struct<role:string,text:string>>")
    formatted = chat.format_turns(turns)
    for r in chat.read_back(formatted).collect():
        assert [(t["role"], t["text"]) for t in r["read_turns"]] == [(t["role"], t["text"]) for t in r["turns"]]
        assert [t["under_loss"] for t in r["read_turns"]] == [t["text"] if t["role"] == "assistant" else "" for t in r["turns"]]
        assert sum(m["chars"] for m in r["mask"]) == len(r["formatted"])
        assert r["formatted"].count("<|im_end|>") == 2


def test_layouts(spark):
    records = [
        ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":null}]}', "messages", [("user", "q"), ("assistant", "")]),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', "from_value", [("user", "q"), ("assistant", "a")]),
        ('{"response":"a","prompt":"q"}', "prompt_response", [("user", "q"), ("assistant", "a")]),
        ('{"instruction":"do","input":"this","output":"done"}', "instruction", [("user", "do\nthis"), ("assistant", "done")]),
        ('{"instruction":"do","input":"","output":"done","system":"s"}', "system_instruction", [("system", "s"), ("user", "do"), ("assistant", "done")]),
        ('{"prompt":1}', None, []),
        ("no json", None, []),
        (None, None, []),
        ("[]", None, []),
    ]
    rows = spark.createDataFrame([(i, r[0], "mine") for i, r in enumerate(records)], "id long, record string, layout string")
    got = {r["id"]: r for r in chat.canonical(rows).collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i]["layout"] == layout and [(t["role"], t["text"]) for t in got[i]["turns"]] == turns, i


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 1, None, "x"), (3, None, "user", "q"), (3, 0, "user", "q"), (3, 0, "user", "q"),
        (None, 0, "assistant", chat.TRAP), (4, 0, "user", ""), (4, 1, "assistant", ""), (5, 0, "human", "h"), (7, 0, "system", "s"), (7, 1, "user", "u"), (7, 2, "assistant", "v" * 200_000),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.format_turns(chat.canonical(chat.records_from_turns(table))))).collect()}
    talks = defaultdict(list)
    for c, t, role, text in rows:
        talks[c].append((t is not None, t or 0, role or "", text or ""))
    for c, turns in talks.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest()), c
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# -- mixing -----------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix(spark, odd_docs):
    rng = random.Random(8)
    rows = [(i, "w " * int(rng.lognormvariate(4, 1)), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(1500)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, source string, taken string")
    got = mixing.mix(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
    targets = plain_targets(sizes)
    most = max(r["size"] for r in got)
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= most
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert mixing.copies(mixing.mix(docs)).count() == sum(r["copies"] for r in got)
    odd = mixing.mix(odd_docs).collect()
    assert len(odd) == 7 and len({r["taken"] for r in odd if r["doc_id"] == 3}) == 1
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_larger_documents_are_likelier(spark):
    rows = [(i, "s", 10 if i % 2 else 1000) for i in range(4000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix_sizes(sized, total=0.5).collect()
    share = {n: np.mean([r["copies"] for r in got if r["size"] == n]) for n in (10, 1000)}
    assert share[1000] > 0.45 and share[10] < share[1000] - 0.2
