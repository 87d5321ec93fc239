"""Substring dedup, line stripping, periodic runs and the token encoder against plain readings."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import line_strip, periodic_runs, substring_dedup, tokens

W = " \t\n\x0b\x0c\r"


def save(spark, path, rows, schema="doc_id long, text string, lang string, part long, batch int"):
    spark.createDataFrame([(*r, "xx", 7, 8) for r in rows], schema).write.parquet(f"{path}/documents.parquet")
    return str(path)


def texts(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "a"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = say(40), "  This LINE comes again and again, 日本  "
    rows = [(i, "\n".join([say(rng.randrange(30)), *([line] if i % 3 else []), *([passage] if i % 4 == 0 else []), say(rng.randrange(9))])) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(9)] + [(5, rows[5][1]), (7, say(50)), (None, say(30) + passage), (None, None), (300, ""), (301, None), (302, "x" * 49), (303, "x" * 400), (304, "\n\n"), (305, " \t ")]
    rows += [(400, (passage + " ") * 60), (401, "ab " * 3000), (402, line + "\n" + line + "\n"), (403, "\x00\x01 " * 30 + passage)]
    rng.shuffle(rows)
    return rows


def test_suffixes_are_in_order_for_the_asked_depth():
    rng = random.Random(3)
    for _ in range(300):
        length, k = rng.choice([8, 12, 50]), rng.choice([1, 2, 3, 26])
        items = list({bytes(rng.randrange(97, 97 + k) for _ in range(length + rng.randrange(60))) for _ in range(rng.randrange(1, 6))})
        ids = np.array([rng.randrange(5) for _ in items])
        text = np.frombuffer(b"".join(x + b"\xff" for x in items), np.uint8)
        order, raw = substring_dedup.suffixes(text, length).tolist(), text.tobytes()
        assert sorted(order) == list(range(len(text)))
        whole = [raw[i : i + length] for i in order if i + length <= len(raw) and b"\xff" not in raw[i : i + length]]
        assert whole == sorted(whole)
        least = {}
        for x, i in zip(items, ids.tolist(), strict=True):
            for j in range(len(x) - length + 1):
                least[x[j : j + length]] = min(i, least.get(x[j : j + length], 9))
        rows, _ = substring_dedup.least_ids(items, ids, length)
        got = {(int(r["item"]), j): int(r["id"]) for r in rows for j in range(r["from"], r["to"])}
        assert got == {(n, j): least[x[j : j + length]] for n, x in enumerate(items) for j in range(len(x) - length + 1)}


def without_repeats(rows, length=50):
    seen, out = set(), []
    by = defaultdict(list)
    for d, t in rows:
        by[-(1 << 63) if d is None else d].append((d, (t or "").encode()))
    for key in sorted(by):
        for d, b in by[key]:
            gone = np.zeros(len(b), bool)
            for k in range(len(b) - length + 1):
                if b[k : k + length] in seen:
                    gone[k : k + length] = True
            spans = int((gone & ~np.concatenate([[False], gone])[:-1]).sum()) if len(b) else 0
            out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
        for _, b in by[key]:
            seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    return sorted(out, key=repr)


def test_substring_dedup_agrees_with_brute_force(spark, tmp_path):
    rows = texts(1)
    got = substring_dedup.op11_substring_dedup(spark, save(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == without_repeats(rows)
    assert sum(r["n_removed"] for r in got) > 10_000


def test_substring_dedup_deals_strings_of_hot_marks_one_by_one(spark, tmp_path):
    rows = texts(2)
    docs = spark.read.parquet(save(spark, tmp_path, rows) + "/documents.parquet")
    got = substring_dedup.without_repeats(docs, hot=3).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], sum(s["length"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=repr) == without_repeats(rows)
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0


def stripped(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(W))
    by, seen, first, lost, out = defaultdict(list), Counter(), {}, Counter(), []
    for d, t in rows:
        by[0 if d is None else 10 * (zlib.crc32(str(d).encode()) % 64) // 64].append((d, t or ""))
    for b in range(10):
        now = Counter()
        for d, t in by[b]:
            lines = t.split("\n")
            keys = [key(x) for x in lines]
            go = [len(k) >= 20 and seen[k] >= 2 for k in keys]
            for k, g in zip(keys, go, strict=True):
                if g:
                    first.setdefault(k, b)
                    lost[k] += 1
            now.update({k for k in keys if len(k) >= 20})
            kept = "\n".join(x for x, g in zip(lines, go, strict=True) if not g)
            out.append(("doc", None if d is None else str(d), b, len(lines), sum(go), hashlib.sha256(kept.encode()).hexdigest()))
        seen += now
    return sorted([*out, *(("line", hashlib.sha256(k.encode()).hexdigest(), first[k], seen[k], n, None) for k, n in lost.items())], key=repr)


def test_line_strip_agrees_with_brute_force(spark, tmp_path):
    rows = texts(4)
    got = line_strip.op12_line_strip(spark, save(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == stripped(rows)
    assert sum(r["row_kind"] == "line" for r in got) >= 2


def test_line_strip_of_an_empty_table(spark, tmp_path):
    assert line_strip.op12_line_strip(spark, save(spark, tmp_path, [])).count() == 0


class Value:
    def __init__(self):
        self.held = None

    def get(self):
        return self.held

    def update(self, new):
        self.held = new


def test_pending_counts_fold_when_a_later_batch_comes_and_not_between_triggers():
    c = line_strip.Counters(2)
    c.state = Value()
    entry = lambda batch, docs: {"batch": batch, "part": batch, "digests": b"d" * 32, "docs": np.array([docs], "<i8").tobytes(), "lines": np.array([docs], "<i8").tobytes()}
    assert list(c.handleInputRows((1,), iter([entry(0, 1)]), None)) == []
    assert list(c.handleInputRows((1,), iter([entry(0, 5)]), None)) == []  # a second trigger of the same batch
    assert len(list(c.handleInputRows((1,), iter([entry(3, 1)]), None))) == 2  # six documents of batch 0
    part, total = list(c.handleInputRows((1,), iter([entry(3, 2)]), None))
    assert part["part"] == 3 and total["part"] == -1
    assert np.frombuffer(total["docs"], "<i8").tolist() == [9] and np.frombuffer(total["lines"], "<i8").tolist() == [2]


def plain_runs(x, least, times):
    n, out = len(x), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                out.setdefault((s, i + q), q)
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_agree_with_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        n, k = rng.choice([0, 1, 2, 5, 10, 20, 40, 80]), rng.choice([1, 2, 2, 3, 4])
        x = [rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.4:
            a, p = rng.randrange(n), 1 + rng.randrange(n)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        for least, times in ((2, 2), (8, 2), (6, 3), (24, 3)):
            assert periodic_runs.runs(np.array(x, np.int64), least, times) == plain_runs(x, least, times)


def test_periodic_runs_query_agrees_with_brute_force(spark, tmp_path):
    rows = texts(6) + [(1000 + i, " ".join(random.Random(i).choice("abcdefgh") for _ in range(90))) for i in range(150)]
    got = periodic_runs.op13_periodic_runs(spark, save(spark, tmp_path, rows)).collect()
    want = []
    for d, t in rows:
        w = [x for x in "".join(" " if c in W else c for c in t or "").split(" ") if x]
        n, h = len(w), 1 if d is None else zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        r = plain_runs(w, 24, 3)
        best = min(r, key=lambda z: (-z[1] / z[2], z[0], z[2])) if r else (None,) * 3
        drop = {i for s, length, q in r for i in range(s + q, s + length)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(r), *best, r and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{length},{q}\n" for s, length, q in r)), sha(" ".join(x for i, x in enumerate(w) if i not in drop))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r["n_runs"] > 0 for r in got) >= 10


@pytest.mark.parametrize("gap", ["  ", " \n", "\n\n", "   ", "\t x ", " "])
def test_encoder_goes_through_odd_texts_in_stretches(gap, monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", 50)
    rng, enc = random.Random(gap), tokens.Encoder()
    words = ["the", "don't", "Ünï", "日本", "12", "3,4", "end.", "x"]
    rows = [gap.join(rng.choice(words) + rng.choice(["", " ", " y"]) for _ in range(n)) + tail for n in (0, 1, 2, 30, 200) for tail in ("", " ", "  ", "\n", " \n ")]
    rows += [" " + r for r in rows] + ["  " + r for r in rows]
    got, want = enc.encode(pa.array(rows)), enc.direct(rows)
    assert [g.tolist() for g in got] == [w.tolist() for w in want]


def test_a_long_odd_text_is_encoded_in_bounded_memory():
    import resource
    import subprocess
    import sys

    code = (
        "import pyarrow as pa, resource\nfrom panelforge.llm import tokens\nenc = tokens.Encoder()\nx = 'some words of a text, ' * 900_000\nx = x[:100] + '  ' + x[100:] + ' \\n '\n"
        "enc.encode(pa.array([x]))\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    )
    assert resource.RUSAGE_SELF == 0
    peak = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert peak < 800, peak  # 20 MB of text; the library needs some 3 GB for it


def test_an_id_that_names_a_side_effect_is_no_sidebar(spark):
    from panelforge.llm import html_extract

    body = "<p>The study went on for two years and saw few of them, all of them mild and short.</p>"
    page = f"<html><body><div class='side'><p>Most read: other things that you may like to see here.</p></div><article><h1>Trial</h1>{body}<section id='side-effects'><h2>Side effects</h2>{body}</section></article></body></html>"
    rows = spark.createDataFrame([(1, "http://a.org/x", page)], "page_id long, url string, html string")
    text = html_extract.extracted(rows).first()["text"]
    assert text.count("two years") == 2 and "Side effects" in text and "Most read" not in text


@pytest.mark.parametrize("pack", [False, True])
def test_secrets_in_wrapped_base64_are_found(pack):
    import base64
    import gzip

    from panelforge.llm import secret_scan

    for seed in range(60):
        rng = random.Random(seed)
        words = [rng.choice(["the", "log", "of", "a", "server", "at", "noon"]) for _ in range(60)]
        at = rng.randrange(60)
        secret = "".join(rng.choice("abcdefXYZ0123456789") for _ in range(20))
        inner = " ".join([*words[:at], f"password={secret}", *words[at:]]).encode()
        wrapped = base64.encodebytes(gzip.compress(inner) if pack else inner).decode()
        for ends in ("\n", "\r\n"):
            text = "see below\n" + wrapped.replace("\n", ends) + "and that was it"
            base, found = secret_scan.all_spans(text)
            assert not [x for x in base if x[2] == 0]
            assert [x for x in found if x[2] == 0 and text.index(wrapped[:10]) <= x[0] < x[1] <= len(text) - 10], (seed, ends)


def test_two_wrapped_digests_are_not_one(spark):
    from panelforge.llm import secret_scan

    text = "0123456789abcdef01234567\nfedcba9876543210fedcba98\n"
    base, found = secret_scan.all_spans(text)
    assert [x[:2] for x in base] == [(0, 24), (25, 49)] and set(base) <= set(found) and (0, 49, 2) not in found


def test_an_address_without_host_is_judged_by_the_method(spark):
    from panelforge.llm import url_filter

    rows = spark.createDataFrame([(1, "http:///casino/win"), (2, None), (3, "no address")], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judged(rows).collect()}
    assert (got[1]["host"], got[1]["path"]) == ("", "/casino/win")
    assert all(r["verdict"] == ("block" if r["score"] >= 0.5 else "allow") for r in got.values())
    assert got[2]["verdict"] == got[3]["verdict"] == "allow"
