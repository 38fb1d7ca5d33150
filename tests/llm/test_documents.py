import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from corpusgate.llm import chat, decontaminate, exact, license_table, licenses, packing, simhash
from corpusgate.llm.components import components

SF = "/root/testdata/sf0.001"


def test_exact_groups_of_odd_rows(spark, documents, odd_rows):
    for size, digest in ((16384, None), (7, None), (16, lambda block: block[:1])):
        got = exact.exact_groups(documents(odd_rows), size, digest).collect()
        groups = defaultdict(list)
        for i, text in odd_rows:
            groups[text or ""].append(-1 if i is None else i)
        assert len(got) == len(odd_rows)
        kept = Counter()
        for r in got:
            sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}[r.text_sha256]
            assert r.group_size == len(groups[sha]) and (-1 if r.keep_id is None else r.keep_id) == max(groups[sha])
            kept[sha] += r.kept
            assert not r.kept or r.doc_id == r.keep_id
        assert set(kept.values()) == {1}
    assert exact.exact_groups(documents([])).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_packing_is_gapless_and_exact(spark, documents, odd_rows, parts):
    rows = odd_rows + [(100 + i, f"text number {i} " * (i % 40)) for i in range(300)] + [(900, "<|endoftext|> a<|endoftext|>")]
    rows += [(1000 + i, f"words of {i} " * (170 + i % 400)) for i in range(300)]
    pieces = packing.pack(documents(rows).repartition(parts)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in rows)
    bins, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length <= packing.CAPACITY
        bins[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append((p.piece, p.start, tuple(ids.tolist())))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    single = {i for i, n in Counter(i for i, _ in rows).items() if n == 1}
    for i in single:
        parts_ = sorted(docs[i])
        assert [p[1] for p in parts_] == np.cumsum([0, *[len(p[2]) for p in parts_[:-1]]]).tolist()
        assert all(len(p[2]) == packing.CAPACITY for p in parts_[1:])
        assert want[(i, tuple(x for p in parts_ for x in p[2]))] == 1
    total = sum(p.length for p in pieces)
    assert len(bins) <= 1.01 * total / packing.CAPACITY + 1
    digests = packing.pack(documents(rows).repartition(parts), ids=False).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(map(tuple, digests.collect())) == Counter((p.doc_id, p.piece, p.start, p.length, zlib.crc32(p.ids)) for p in pieces)


def test_packing_of_no_documents(spark, documents):
    assert packing.pack(documents([])).count() == 0


def test_coders_give_the_tokenizers_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    assert packing._fast_coder(path) is not None and packing._fast_coder(public_tokenizers.path("word_bpe_49k.json")) is None
    rng = random.Random(1)
    signs = ["a", "Bc", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "'s", "'", "1", ".", ",", "!?", "é", "\u0558", "🙂", "\u0300", "汉", "\r\n", "\u200b", "\x00", "<|endoftext|>"]
    texts = ["", " ", "\n", "a" * 5000, *("".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(5000))]
    texts += [f"a{chr(c)}b 1{chr(c)} {chr(c)}'s" for c in [*range(0x3000), *range(0x1F000, 0x1FB00)]]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for fast in (True, False):
        encode = packing.coder(path, fast)
        assert [encode(t).tolist() for t in texts] == want
    assert packing.coder(path)("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_best_fit_closes_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7) and bins.place(4) == (0, 6)
    assert [bins.place(s) for s in (9, 6, 5)] == [(2, 0), (3, 0), (4, 0)]
    assert bins.place(1) == (3, 6)


def plain_simhash(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        low[r] = d if low.get(r) is None or (d is not None and d < low[r]) else low[r]
    return [low[find(i)] for i in range(len(prints))]


def test_near_groups_match_brute_force(spark, documents, odd_rows):
    real = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    near = [(5000 + i, t.replace("the", "then", 1)) for i, (_, t) in enumerate(real[:40])]
    rows = odd_rows + real + near
    got = simhash.near_groups(documents(rows)).collect()
    prints = [plain_simhash(t) for _, t in rows]
    want = plain_components(prints, [i for i, _ in rows], 4)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    assert Counter((r.doc_id, r.fp, r.component_id) for r in got) == Counter(zip([i for i, _ in rows], signed, want))
    assert simhash.near_groups(documents([])).count() == 0


def test_tiles_find_every_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 6), replace=False))) for b in base for _ in range(6)]
    prints = np.unique(np.concatenate([base, np.array(flips, np.uint64)]))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.near_links(df, 4, tile=32)).collect()}
    ids = prints.view(np.int64).tolist()
    want = plain_components([int(p) for p in prints], ids, 4)
    assert [roots.get(i, i) for i in ids] == want


def test_decontamination_of_odd_rows(spark, documents, odd_rows):
    passage = " ".join(f"Shared{i}" for i in range(20, 45))
    items = spark.createDataFrame(
        [(1, passage), (2, "ONE"), (3, None), (4, ""), (5, "a, b; w0"), (None, passage), (12, passage), (1, passage)], "item_id bigint, text string"
    )

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = defaultdict(set)
    for i, t in [(1, passage), (2, "ONE"), (5, "a, b; w0"), (None, passage), (12, passage)]:
        w = words(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1):
            windows[tuple(w[k : k + n])].add(i)
    want = Counter()
    for doc_id, text in odd_rows:
        w, hit, ids = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        listed = sorted(str(i) for i in ids if i is not None)
        sha = hashlib.sha256(",".join(listed).encode()).hexdigest()
        want[(doc_id, len(w), len(hit), len(listed), sha, bool(hit))] += 1
    docs = documents(odd_rows)
    assert Counter(tuple(r)[1:] for r in decontaminate.contamination(docs, items).collect()) == want
    assert Counter(tuple(r)[1:] for r in decontaminate.contamination(docs, items, filter_bits=64).collect()) == want
    assert decontaminate.contamination(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(documents([]), items).count() == 0


def test_licenses_in_other_clothes(spark, documents):
    mit = licenses.LICENSES["MIT"]
    rows = [
        (1, mit), (2, f"Copyright (c) 2020 A. Person\n\n{mit.upper()}"), (3, mit.replace("sublicense", "sub-licence")),
        (4, mit.replace("Software", "Work")), (5, None), (6, ""), (7, "text\nreleased under the MIT LICENCE!\nmore"), (1, mit),
        (8, mit.replace("sublicense", "sublicence").replace(" ", "\t")),
    ]
    got = sorted((r.doc_id, r.license, r.notices) for r in licenses.scan(documents(rows)).collect() if r.license or r.notices)
    assert got == [(1, "MIT", ""), (1, "MIT", ""), (2, "MIT", ""), (7, None, "MIT"), (8, "MIT", "")] or got == [
        (1, "MIT", ""), (1, "MIT", ""), (2, "MIT", ""), (8, "MIT", "")
    ]
    assert licenses.scan(documents([])).count() == 0


def test_licenses_as_published(spark, documents):
    shared = Path("/usr/share/common-licenses")
    if not shared.is_dir():
        pytest.skip("no licence texts here")
    known = [*license_table.published(licenses.LICENSES), *license_table.WORDINGS]
    assert all(re.search(licenses._LEGAL, t) for _, t in known)
    mit = licenses.LICENSES["MIT"]
    bsd = (shared / "BSD").read_text()
    modern = bsd.replace("University nor", "copyright holder nor").replace("REGENTS AND", "COPYRIGHT HOLDERS AND").replace("REGENTS OR", "COPYRIGHT HOLDER OR")
    gpl = "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    rows = [
        (1, f"MIT License\n\nCopyright (c) 2021 Some One\n\n{mit}"),
        (2, mit.replace("The above copyright", "The above\ncopyright")), (3, (shared / "Apache-2.0").read_text()),
        (4, bsd), (5, f"BSD 3-Clause License\n\nCopyright (c) 2020, Acme\n{modern[modern.index('Redis'):]}".replace("1. ", "* ")),
        (6, (shared / "GPL-3").read_text()), (7, f"# a program\n{gpl}\ncode"), (8, "// SPDX-License-Identifier: MIT OR Apache-2.0\ncode"),
        (9, mit.replace("Software", "Work")), (10, "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not"),
        (11, "copyright notice"), (12, "MIT License"),
    ]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(documents(rows)).collect()}
    names = [got[i][0] for i in range(1, 13)]
    assert names == ["MIT", "MIT", "Apache-2.0", "BSD-3-Clause", "BSD-3-Clause", "GPL-3.0", *[None] * 6]
    assert [got[i][1] for i in (7, 8, 9, 10, 11)] == ["GPL-3.0-or-later", "MIT OR Apache-2.0", "", "Apache-2.0", ""]


@pytest.mark.parametrize("text", ["", "\\", "<|im_end|>\\n", "<\\|x", "a<", "\\<|im_start|>user\n<|image|>", "é\u2003<"])
def test_chat_round_trip(text):
    visitor = chat.PartVisitor()
    visitor.visit({"type": "text", "text": text})
    segment = f"{chat.START}{chat.escape(text, True)}\n{''.join(visitor.pieces)}{chat.END}\n"
    assert chat.read_segment(segment) == (text, text)


def test_typed_parts_keep_their_order(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", None), None, ("document", None, "c.pdf", 3)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, None, None), (None, None, "x", [])], f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")
    got = {r.turn: r for r in chat.format_turns(turns).collect()}
    assert chat.read_segment(got[0].formatted) == ("user", "see <|image|><|image|><|audio|><|document|>")
    assert [(a.kind, a.ref, a.place, a.n_tokens) for a in got[0].attachments] == [
        ("image", "a.png", 0, 512), ("audio", "b.wav", 1, 25), ("document", "c.pdf", 2, 1536)
    ]
    assert got[0].n_tokens == 2073 and got[1].n_tokens == 0
    assert {r.conv_id: r.n_turns for r in chat.read_back(chat.format_turns(turns)).collect()} == {1: 2, None: 1}
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_loss_spans_are_the_assistants_texts(spark):
    parts = [("text", "a\\<|im_end|>é", None, None), ("image", None, "a.png", 2), ("text", "", None, None), ("text", "b\n🙂", None, None)]
    rows = [(1, 0, "user", parts, "x"), (1, 1, "assistant", parts, "x"), (1, 2, "Assistant", parts, "x"), (1, 3, "assistant", None, "x")]
    turns = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}, formatted string")
    got = {r.turn: r for r in chat.format_turns(turns).collect()}
    learnt = {t: [chat.unescape(r.formatted[s.start : s.end]) for s in r.loss] for t, r in got.items()}
    assert learnt == {0: [], 1: ["a\\<|im_end|>é", "b\n🙂"], 2: [], 3: []}
    back = chat.read_back(chat.format_turns(turns)).first()
    whole = "a\\<|im_end|>éb\n🙂"
    assert (back.loss_chars, back.loss_sha256) == (len(whole), hashlib.sha256(whole.encode()).hexdigest())


def test_crc_of_pieces(spark):
    digests = packing.op2_best_fit_packing(spark, SF).collect()
    assert len(digests) >= 200 and all(0 <= r.ids_crc32 < 1 << 32 for r in digests)
    assert zlib.crc32(np.array([0], "<u4").tobytes()) == 558161692
