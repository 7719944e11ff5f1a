"""The text operators on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import random
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexweave.llm import corpus_tokens, encodings, key_files, leakage, lookalikes, queries, repeated_lines, scan_noise, splitting, text_stats

T0 = datetime(2025, 1, 1)
PAGE = "page_id long, job_key string, book string, page_number int, printed_page string, text string, ingested_at timestamp_ntz, source_pdf string, line string, n int"
STATUS = "snapshot_id long, job_key string, source_pdf string, mode string, text string"


def pages_of(spark, rows):
    """Pages from (page_id, job, text), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(p, j, "书", i + 1, None, t, T0, "clash", "clash", 1) for i, (p, j, t) in enumerate(rows)], PAGE)


def status_of(spark, rows):
    return spark.createDataFrame([(i, j, s, m, "clash") for i, (j, s, m) in enumerate(rows)], STATUS)


def brute_lines(rows, sources):
    on, size = defaultdict(set), defaultdict(set)
    for page, job, text in rows:
        if sources.get(job) and text and text.strip():
            size[sources[job]].add(page)
            for line in text.split("\n"):
                if line := " ".join(line.split()):
                    on[sources[job], line].add(page)
    return {k for k, v in on.items() if len(v) >= 8 and len(v) * 100 >= 15 * len(size[k[0]])}


def test_repeated_lines_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for page in range(400):
        job = "hot" if page % 3 else f"j{page % 7}"
        lines = [f"unique {page} {i}" for i in range(3)] + [" 版权 所有 "] * (rng.random() < 0.5) + ["rare"] * (rng.random() < 0.1) + ["twice", "twice"]
        rows.append((page, job, "\n".join(lines) if page % 50 else None))
    rows += rows[:40] + [(900, "hot", ""), (901, "none", "版权 所有")]
    sources = {"hot": "a.pdf", **{f"j{i}": f"{i % 2}.pdf" for i in range(7)}}
    status = status_of(spark, [(j, s, None) for j, s in sources.items()] + [("hot", None, None)])
    got = {tuple(r) for r in repeated_lines.repeated_lines(pages_of(spark, rows), status).collect()}
    assert got == brute_lines(rows, sources) and got
    clean = {r.page_id: r for r in repeated_lines.without_repeated_lines(pages_of(spark, rows), status).collect()}
    assert len(clean) == 402 and clean[0].text is None and "版权" not in clean[1].text and clean[901].text == "版权 所有"
    assert clean[1].n_removed >= 2 and clean[900].text == ""


def test_repeated_lines_of_nothing(spark):
    assert repeated_lines.repeated_lines(pages_of(spark, []), status_of(spark, [])).count() == 0
    assert repeated_lines.without_repeated_lines(pages_of(spark, []), status_of(spark, [])).count() == 0


CHUNK = "chunk_id string, job_key string, text string, mode string, max_chars int"
LIMITS = "item_kind string, mode string, max_chars int, overlap_chars int"


def test_pieces_fit_overlap_and_join_to_the_text(spark):
    rng = random.Random(1)
    words = ["字", "。", "，", "\n", "word ", "𠮷", "é", "\r\n", "\n\n", "́", "🧭"]
    texts = ["".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 59, 60, 61, 300, 5000)] + [None, "x" * 500]
    pages = pages_of(spark, [(i, "j", t) for i, t in enumerate(texts)])
    chunks = spark.createDataFrame([("c", "j", "y" * 45, "clash", 1), ("c", "j", "y" * 45, "clash", 1), (None, "j", "y" * 99, "clash", 1)], CHUNK)
    status = status_of(spark, [("j", None, "m"), ("j", None, None)])
    limits = spark.createDataFrame([("page", "m", 60, 12), ("chunk", "m", 40, 0), ("page", "other", 1, 0)], LIMITS)
    found = {tuple(r) for r in splitting.oversized(pages, chunks, status, limits).collect()}
    assert found == {("page", str(i)) for i, t in enumerate(texts) if t and len(t) > 60} | {("chunk", "c")}
    made = defaultdict(list)
    for r in splitting.split_items(pages, chunks, status, limits).orderBy("piece_no").collect():
        made[r.item_kind, r.item_id].append(r)
    for i, text in enumerate(texts):
        out, last = "", None
        for r in made.get(("page", str(i)), []):
            assert len(r.text) <= 60 and text[r.start_at : r.start_at + len(r.text)] == r.text
            if last:
                assert r.start_at == last.start_at + len(last.text) - 12
            out, last = out[: r.start_at] + r.text, r
        assert out == (text or "")
    assert [len(r.text) for r in made["chunk", "c"]] == [40, 5]


def test_pieces_prefer_strong_boundaries(spark):
    items = spark.createDataFrame([("page", "1", "a" * 30 + "\n\n" + "b" * 20 + ". " + "c" * 30, 50, 0)], "item_kind string, item_id string, text string, max_chars int, overlap_chars int")
    got = [r.text for r in splitting.pieces(items, [(50, 0)]).orderBy("piece_no").collect()]
    assert got[0] == "a" * 30 + "\n\n"


def test_pieces_of_a_long_item_and_of_short_parts(spark):
    schema = "item_kind string, item_id string, text string, max_chars int, overlap_chars int"
    long = "字句，甲乙。\n" * 60_000
    marks = "e" + "\u0301" * 40 + "x" * 5
    items = spark.createDataFrame([("page", "1", long, 400, 40), ("page", "2", marks, 10, 8), ("page", "3", "abc", 400, 40)], schema)
    made = defaultdict(list)
    for r in splitting.pieces(items, [(400, 40), (10, 8)]).orderBy("piece_no").collect():
        made[r.item_id].append(r)
    for key, text, most, shared in (("1", long, 400, 40), ("2", marks, 10, 8), ("3", "abc", 400, 40)):
        end = 0
        for r in made[key]:
            assert len(r.text) <= most and r.start_at == max(0, end - shared) * (r.piece_no > 1) and text[r.start_at : r.start_at + len(r.text)] == r.text
            end = r.start_at + len(r.text)
        assert end == len(text)


def _encoder():
    return corpus_tokens._encoding(f"{corpus_tokens.TOKENIZER_FOLDER}/{corpus_tokens.RANKS}")


def test_token_ids_are_the_tokenizers(spark):
    rng = random.Random(2)
    alphabet = [*" \t\n\r  　'\"", "'s", "'ll", "''s", "don't", "字", "é", "é", "1", "２", "½", "…", "🧭", "Ⅻ", "a", "B", "<|endoftext|>", "", "​"]
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in [0, 1, 2, 3] * 40 + [200] * 40] + [None, "", "x" * 100_000, " " * 5000]
    df = spark.createDataFrame([(i, t, T0, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids timestamp_ntz, block string")
    ids = corpus_tokens.corpus_ids(df)
    assert dict(ids.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got == {i: _encoder().encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in corpus_tokens.decoded(ids).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert corpus_tokens.corpus_ids(df.limit(0)).count() == 0


def test_token_ids_do_not_depend_on_the_spread_of_words(spark, monkeypatch):
    texts = [f"the mill {i} and the kiln\n字{i}" for i in range(300)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(corpus_tokens, "BLOCK_BYTES", 64)
    monkeypatch.setattr(corpus_tokens, "WORD_BLOCKS", 4)
    got = {r.doc_id: r.ids for r in corpus_tokens.corpus_ids(df).collect()}
    assert got == {i: _encoder().encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


LOOKS = ["The mill stood  here", "Тhe mіll stооd  here", "Ｔｈｅ mill stood  here", "The mi​ll st­ood  here", "The mill stood 2", "The mill stood ²", "the mill stood  here", "用水面", "⽤⽔⾯", "café", "café", "ＡＢ１", "AB1", "①", "1", "АБВГД слово", "ﬆone", "stone", None, "", " ​"]


def test_same_look_pairs(spark):
    rows = [(i, "j", t) for i, t in enumerate(LOOKS)]
    rows += [(100, "j", LOOKS[0])] + rows[:3]
    got = {tuple(r) for r in lookalikes.same_look(pages_of(spark, rows)).collect()}
    want = set()
    texts = {p: t for p, _, t in rows}
    for a in texts:
        for b in texts:
            if a < b and texts[a] and texts[b] and texts[a] != texts[b] and lookalikes.folded(texts[a]).strip() and lookalikes.folded(texts[a]) == lookalikes.folded(texts[b]):
                want.add((a, b))
    assert got == want
    assert {(0, 1), (0, 2), (0, 3), (7, 8), (9, 10), (11, 12), (16, 17), (1, 100)} <= got
    assert not {(0, 100), (4, 5), (0, 6), (13, 14)} & got


def test_canonical_spelling_keeps_real_words_of_other_scripts(spark):
    rows = [(1, "j", "слово слово АТОМ"), (2, "j", "cлoвo АТОМ"), (3, "j", "atom stood stооd stood")]
    forms = {r.page_id: r.form for r in lookalikes.forms(pages_of(spark, rows)).collect()}
    assert forms[2].startswith("слово") and forms[3] == "atom stood stood stood"
    assert lookalikes.Trie().matches("x") == []


def test_forms_are_the_same_with_one_trie_or_many(spark, monkeypatch):
    rows = [(i, "j", t) for i, t in enumerate([*LOOKS[:4], "слово слово 字字", "cлoвo", None, "", "stood stооd stood mill"])]
    rows += rows[:3]
    one = sorted(((r.page_id, r.text, r.form) for r in lookalikes.forms(pages_of(spark, rows)).collect()), key=str)
    monkeypatch.setattr(lookalikes, "TRIE_ROWS", 1)
    two = sorted(((r.page_id, r.text, r.form) for r in lookalikes.forms(pages_of(spark, rows)).collect()), key=str)
    assert one == two and len(one) == len(rows) and (6, None, None) in one and (7, "", "") in one


def test_look_classes(spark):
    rows = [(i, "j", t) for i, t in enumerate(LOOKS)] + [(100, "j", LOOKS[0]), (0, "j", LOOKS[0])]
    got = {r.page_id: r for r in lookalikes.look_classes(pages_of(spark, rows)).collect()}
    assert got[0].class_id == got[3].class_id == got[100].class_id != got[4].class_id
    assert (got[0].n_pages, got[0].n_links, got[1].n_links, got[4].n_links) == (5, 3, 4, 0)
    pairs = lookalikes.same_look(pages_of(spark, rows)).count()
    assert sum(r.n_links for r in got.values()) == 2 * pairs
    assert lookalikes.look_classes(pages_of(spark, [])).count() == 0


def test_key_files_hold_texts_and_numbers(spark):
    words = [f"key {i}" for i in range(3000)]
    high, low = (h.to_pylist() for h in key_files.halves(words))
    texts = key_files.key_files(spark.createDataFrame(list(zip(high, low, [w * 2 + "字" for w in words])), "high long, low long, t string"), "test")
    assert all(texts.text(w) == w * 2 + "字" for w in words) and texts.text("none") is None
    numbers = key_files.key_files(spark.createDataFrame(list(zip(high, low, range(1, 3001))), "high long, low long, n long"), "test")
    assert [numbers[w] for w in words] == list(range(1, 3001)) and numbers["none"] == 0
    assert key_files.key_files(spark.createDataFrame([], "high long, low long, n long"), "test")["none"] == 0


CLEAN = ["为什么双桥的高粱比澄岭的更耐用？裁缝渐渐归因于名称与运输。", "Le forgeron répétait que la forêt servait déjà là-bas, malgré ses pièces.", "Für den Zöllner war die schöne Größe „mäßig“ ausreichend.", "The sailor’s ladder — “old” and new."]


def test_encodings_found_and_restored(spark):
    wrong = {
        100: corpus_bytes(CLEAN[0], "utf-8", "latin-1"),
        101: corpus_bytes(CLEAN[0], "gb18030", "latin-1"),
        102: corpus_bytes(CLEAN[0], "utf-8", "gb18030"),
        103: corpus_bytes(CLEAN[1], "utf-8", "cp1252"),
        104: corpus_bytes(corpus_bytes(CLEAN[1], "utf-8", "cp1252"), "utf-8", "cp1252"),
        105: corpus_bytes(CLEAN[2], "cp1252", "mac_roman"),
        106: "Lost �� here",
    }
    rows = [(i, "j", CLEAN[i % 4]) for i in range(1000, 9000)] + [(p, "j", t) for p, t in wrong.items()]
    rows += [(200, "j", None), (201, "j", ""), (202, "j", "ФОНД ЧЕРТЕЖЕЙ, ЛИСТ 587"), (203, "j", "Größe 635 — “Ä”, “Ö”, “Ü” 口腔 ½ ×÷ ‰"), *[(p, "j", t) for p, t in list(wrong.items())[:2]]]
    result = encodings.repaired(pages_of(spark, rows))
    got = {r.page_id: r for r in result.collect()}
    assert {p for p, r in got.items() if r.found} == set(wrong)
    assert all(got[p].text == CLEAN[0] for p in (100, 101)) and got[103].text == got[104].text == CLEAN[1]
    assert got[106].lossy and got[200].text is None and got[201].text == ""
    assert encodings.wrongly_decoded(pages_of(spark, rows)).count() == len(wrong)
    assert encodings.repaired(pages_of(spark, [])).count() == 0


def corpus_bytes(text, true, wrong):
    return text.encode(true, "ignore").decode(wrong, "replace")


def test_encodings_behind_a_costlier_state(spark):
    text = "又从安浦调来"
    garbled = corpus_bytes(corpus_bytes(text, "utf-8", "latin-1"), "utf-8", "gb18030")
    filler = "据1846年的水闸记载，守塔人与修钟匠又从安浦调来一处盐卤，Größe, forêt."
    rows = [(i, "j", filler + CLEAN[i % 4]) for i in range(1000)] + [(5000, "j", f"守塔人{filler}\n\n{garbled}\n\n修钟匠"), (5001, "j", "ФОНД ЧЕРТЕЖЕЙ, ЛИСТ 587")]
    got = {r.page_id: r for r in encodings.repaired(pages_of(spark, rows)).collect()}
    assert {p for p, r in got.items() if r.found} == {5000} and text in got[5000].text.split("\n\n")


def test_escapes_in_pages_of_other_letters(spark):
    word = "高粱"
    escapes = ["".join(f"&#x{ord(c):X};" for c in word), "".join(f"&amp;#{ord(c)};" for c in word), "".join(f"\\u{ord(c):04x}" for c in word), *("".join(f"{sign}{b:02X}" for b in word.encode()) for sign in "%=")]
    rows = [(i, "j", CLEAN[i % 4] + " 3 & 4 = 7, 5 %") for i in range(1000)] + [(5000 + i, "j", CLEAN[0].replace(word, e)) for i, e in enumerate(escapes)]
    got = {r.page_id: r for r in encodings.repaired(pages_of(spark, rows)).collect()}
    assert {p for p, r in got.items() if r.found} == {5000 + i for i in range(len(escapes))}
    assert all(got[5000 + i].text == CLEAN[0] for i in range(len(escapes)))


def test_encodings_that_damaged_pages_themselves_make_common(spark):
    mac = [corpus_bytes(f"{CLEAN[0]}第{i}号", "gb18030", "mac_roman") * 9 for i in range(12)]
    lost = ["第{i}号\n" + corpus_bytes("\ufffd" * 60, "utf-8", "gb18030") for i in range(12)]
    rows = [(i, "j", CLEAN[i % 4]) for i in range(1000)] + [(5000 + i, "j", t) for i, t in enumerate(mac + lost)]
    got = {r.page_id: r for r in encodings.repaired(pages_of(spark, rows)).collect()}
    assert {p for p, r in got.items() if r.found} == set(range(5000, 5024))
    assert got[5003].text == f"{CLEAN[0]}第3号" * 9 and got[5012].lossy and "\ufffd" in got[5012].text and "锟" not in got[5012].text


def test_search_walks_what_a_plain_walk_reaches():
    rng = np.random.default_rng(5)
    costs = rng.uniform(4, 26, 0x110000).astype(np.float32)
    costs[0x1A] = costs[0xFFFD] = encodings.LOST
    for text in ("é¼", "氓聫", "ÃŸ€", "&eacute;¼"):
        start = encodings.cost_of(text, costs)
        prices = {text: start}
        for first, _ in encodings.neighbours(text, {}):
            prices[first] = min(prices.get(first, 999), encodings.cost_of(first, costs) + encodings.STEP)
            for second, name in encodings.neighbours(first, {}):
                if name.endswith(">utf-8"):
                    prices[second] = min(prices.get(second, 999), encodings.cost_of(second, costs) + 2 * encodings.STEP)
        least = min(prices.values())
        assert start - least < encodings.MIN_GAIN or encodings.cheapest(text, costs)[1] >= start - least - 0.01


PASSAGE = "The dry wellhead from Ashport fetched 360 pence, for reasons given in chapter 8. As for Lorlea, the loose chart and the greyish bookspine stood side by side, whereupon the level rose 15 inches."
IDEOGRAPHS = "据1846年的水闸记载，守塔人与修钟匠已经合用一处盐卤，旁边还注着尺寸。凡干燥的鱼干，先用清水浸550日，再以灯笼压平，比往年早了14日。"


def test_leaks(spark):
    filler = " ".join(f"Word {i} stands alone in {i * 7} places." for i in range(60))
    half = PASSAGE[: int(len(PASSAGE) * 0.6)]
    docs = [
        (1, filler + PASSAGE + filler), (2, filler + PASSAGE.upper().replace(",", "").replace(" ", "\n") + filler), (3, filler + half + filler),
        (4, filler + PASSAGE[:60] + filler), (5, None), (6, ""), (7, "前言。" + IDEOGRAPHS.replace("守塔人", "守堤人") + "后记。"), (8, PASSAGE.replace("loose", "narrow")), (1, filler + PASSAGE + filler), (9, filler * 300),
    ]
    documents = spark.createDataFrame([(d, t, "clash", 0.0) for d, t in docs], "doc_id long, text string, item_id string, share double")
    items = spark.createDataFrame([(10, PASSAGE), (11, PASSAGE), (12, IDEOGRAPHS), (13, None), (14, ""), (10, PASSAGE)], "item_id long, passage string")
    got = {tuple(r) for r in leakage.leaks(documents, items).collect()}
    assert got == {(d, i) for d in (1, 2, 3, 8) for i in (10, 11)} | {(7, 12)}
    assert {tuple(r) for r in leakage.leak_shares(documents, items, block_chars=150).where("share >= 0.5").select("doc_id", "item_id").collect()} == got
    assert leakage.leaks(documents.limit(0), items).count() == 0 and leakage.leaks(documents, items.limit(0)).count() == 0


def test_leaks_in_two_uneven_stretches(spark):
    filler = " ".join(f"Word {i} stands alone in {i * 7} places." for i in range(60))
    n = len(PASSAGE)
    uneven = filler + PASSAGE[: int(n * 0.4)] + filler + PASSAGE[int(n * 0.8) :] + filler
    repeated = filler.join([PASSAGE[: int(n * 0.34)]] * 10) + filler + PASSAGE[int(n * 0.74) :] + filler
    documents = spark.createDataFrame([(1, uneven), (2, repeated), (3, filler + PASSAGE[: int(n * 0.4)] + filler)], "doc_id long, text string")
    items = spark.createDataFrame([(10, PASSAGE)], "item_id long, passage string")
    assert {tuple(r) for r in leakage.leaks(documents, items).collect()} == {(1, 10), (2, 10)}


def test_leaks_of_short_passages(spark):
    filler = " ".join(f"Word {i} stands alone in {i * 7} places." for i in range(60))
    short = {20: "Zebra quilts vex a judge.", 21: "Brown foxes jump over lazy dogs at night", 22: "守塔人合用盐卤一处", 23: "Quiz me", 24: "石匠", 25: "!?"}
    docs = [(i, f"{filler}, {p.upper()}; {filler}") for i, p in short.items()] + [(1, filler), (2, filler + "Brown fox terriers jump"), (3, f"{filler} Brown foxes jump over crazy dogs at night {filler}")]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(list(short.items()), "item_id long, passage string")
    got = {tuple(r) for r in leakage.leaks(documents, items).collect()}
    assert got == {(i, i) for i in short if i != 25} | {(3, 21)}


def test_winnowing_keeps_its_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(50):
        span = rng.integers(0, 50, 40).astype(np.uint32)
        a = np.concatenate([rng.integers(50, 99, 30).astype(np.uint32), span, rng.integers(50, 99, 9).astype(np.uint32)])
        b = np.concatenate([span, rng.integers(100, 199, 20).astype(np.uint32)])
        h = [leakage.gram_hashes(x, 24) for x in (a, b)]
        kept = [set(x[leakage.winnowed(x, 8)].tolist()) for x in h]
        assert kept[0] & kept[1]


def test_structure_of_documents(spark):
    prose = "据1846年的水闸记载，守塔人与修钟匠已经合用一处盐卤，旁边还注着尺寸。"
    docs = {
        1: (prose + prose.replace("据", "又据").replace("守塔人", "石匠"), None), 2: ("目录\n" + "\n".join(f"第{i}节 水车的形制 ........ {i * 3}" for i in range(1, 20)), "list"),
        3: ("\n".join("\t".join(str((i * j * 37) % 991) for j in range(1, 6)) for i in range(1, 20)), "table"), 4: ("田田回" * 200, "junk"),
        5: ("Gnj9 vbBsmknD80 CjGkc 3p7 8Cwpkn8vQ wv D0X q3pF hxpp6t1Hgm94m ndwxhv lxGg", "junk"), 6: (None, None), 7: ("", None), 8: (" \n\n", None),
        9: ("1. The first chapter tells of the mill and of the men who kept it when the water fell, and of much else.", None),
        10: ("晴埠始终望，坚硬的瓷窑留在安堡\n石坊逐年思，罕见的堤坝留在竹坊", None), 11: (prose * 40, "junk"),
        12: ("\n".join(f"• item {w}" for w in ("mill", "raft", "kiln", "loom", "chart")), "list"),
    }
    rows = [(d, t, "clash") for d, (t, _) in docs.items()] + [(2, docs[2][0], "clash")] + [(100 + i, prose.replace("盐卤", f"盐{i}卤") + CLEAN[i % 4], "x") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r.doc_id: r.kind for r in text_stats.structured(df).collect()}
    assert got == {d: k for d, (_, k) in docs.items() if k}
    stats = {r.doc_id: r for r in text_stats.document_statistics(df).collect()}
    assert stats[6].kind is None and stats[7].n_words == 0 and stats[1].kind == "prose" and 0 < stats[1].ended_line_share <= 1
    assert text_stats.structured(df.limit(0)).count() == 0
    assert text_stats.divergence(np.array([1.0, 0.0]), np.array([0.0, 1.0])) == pytest.approx(1.0)
    assert stats[1].n_words == 2 * sum("一" <= c <= "鿿" for c in prose) and stats[1].mean_word_length == 1.0


def test_profiles_are_fitted_on_every_document(spark):
    """A few documents among thousands tell what a language looks like, wherever they stand."""
    ids = [r.id for r in spark.range(3100).orderBy(F.xxhash64("id"), "id").collect()]

    def line(function, others):
        return " ".join(["the"] * function + ["kormills"] * others)

    def languages(heavy):
        rows = [(ids[0], line(10, 13))] + [(i, "x") for i in ids[1:3050]] + [(i, "\n".join([line(10, 10)] * 40)) for i in heavy]
        return {r.doc_id: r.nearest_language for r in text_stats.document_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    assert languages([])[ids[0]] == "de"
    assert languages(ids[3050:])[ids[0]] == "en" == languages([i + 10**6 for i in ids[:50]])[ids[0]]


def test_lines_with_a_form_are_nearest_to_profiles_of_that_form():
    rng = np.random.default_rng(4)
    counts, forms = rng.integers(0, 9, (400, 7)) * (rng.random((400, 7)) < 0.3) + np.eye(7, dtype=int)[rng.integers(0, 7, 400)], rng.integers(0, 4, 400)
    profiles = text_stats.prior_profiles()
    kinds = [text_stats._KIND_OF[i] for i in text_stats.nearest(text_stats.vectors(counts, forms), profiles)]
    assert kinds == [text_stats.FORMS[f] for f in forms]


def test_class_counts_like_a_plain_count():
    lines = ["The mill of 1846, and Der Müller!", "据1846年的水闸记载，守塔人。", "", "a b|c", "x" * 50]
    table = text_stats.class_table(np.zeros(0x110000, np.float32))
    counts, words, letters = text_stats.class_counts(lines, table)
    for line, row, n, size in zip(lines, counts, words, letters, strict=True):
        runs = [w for w in __import__("re").findall(r"[^\W\d_]+", line) if w.isascii() or "ü" in w]
        zh = [c for c in line if "一" <= c <= "鿿"]
        known = sum(len(w) for w in runs if w.casefold() in text_stats._WORDS) + sum(c in text_stats.FUNCTION_CHARS for c in zh)
        assert row.sum() == len(line) and row[0] == known and row[3] == sum(map(str.isdigit, line)) and n == len(runs) + len(zh) and size == sum(map(len, runs)) + len(zh)


def test_endless_is_the_repeated_share_where_it_is_high():
    rng = random.Random(2)
    for text in ["ab" * 300, "".join(rng.choice("abcdefgh ") for _ in range(2000)), "row 1 | row 2\n" * 80, "x" * 9, "甲乙丙丁" * 5000, "".join(f"{i} " for i in range(9000))]:
        again = text_stats.repeated_share(text)
        assert text_stats.endless(text) == (again if again > text_stats.REPEATED else 0.0)


def noisy_pages():
    rng = random.Random(4)
    nouns = ["temperature", "candlestick", "furnace", "genealogy", "typeface", "wellhead", "schoolmaster", "manuscript"]
    rows = []
    for n in range(1, 121):
        body = [f"The {rng.choice(nouns)} of the hand-cut {rng.choice(nouns)} was {rng.choice(['kept', 'sold'])} and the {rng.choice(nouns)} stood beside it" for _ in range(6)]
        body += [f"据{1800 + n}年的记载，守塔人与石匠已经把木桶搬到日晷旁，大潮之夜才清点。", "那年夏天，铁匠说，未上漆的木料最容易受损。"]
        rows.append(["A Book of Mills", *body, f"— {n + 6} —"])
    return rows


def test_scan_noise(spark):
    rows = noisy_pages()
    rows[50][1] = "The schoolrnaster of the hand-cut furnace was kept"
    rows[51][1:3] = ["The genealogy was kept beside the candle-", "stick and the hand-"]
    rows[51].insert(3, "cut furnace stood beside it")
    rows[52][7] = "据1852年的记载，守塔人与右匠已经把本桶搬到曰晷旁。"
    rows[53][3] = rows[53][3][:20] + "~" + rows[53][3][20:]
    rows[54][2] = "59"
    pages = [(n, "j", "A Book of Mills", n, None, "\n".join(lines), T0, "c", "c", 1) for n, lines in enumerate(rows, 1)]
    pages += pages[50:53] + [(500, "j", "A Book of Mills", 500, None, None, T0, "c", "c", 1), (501, "j", None, None, None, "", T0, "c", "c", 1)]
    df = spark.createDataFrame(pages, PAGE)
    got = {tuple(r) for r in scan_noise.noise(df).collect()}
    ends = {n: len(lines) for n, lines in enumerate(rows, 1)}
    assert {(n, ends[n], "page_number") for n in ends} == {g for g in got if g[2] == "page_number"}
    assert {(n, 1, "header") for n in ends} == {g for g in got if g[2] == "header"}
    assert {g for g in got if g[2] == "hyphen"} == {(52, 2, "hyphen")}
    assert {g for g in got if g[2] == "misread"} == {(51, 2, "misread"), (53, 8, "misread"), (54, 4, "misread")}
    text = {r.page_id: r.text for r in scan_noise.repaired(df).collect()}
    assert "schoolmaster" in text[51] and "candlestick and the hand-cut furnace" in text[52] and "石匠已经把木桶搬到日晷旁" in text[53]
    assert "A Book of Mills" not in text[1] and text[500] is None and text[501] == ""


def test_heads_and_openings(spark):
    words = ["灯塔", "磨坊", "水车", "铁匠", "石匠", "木桶", "草席", "渔网", "药柜", "书架", "盐田", "丝线"]
    rows, want = [], set()

    def put(book, number, line, head=True):
        page = len(rows) + 1
        rows.append((page, f"j{book}", f"书{book}号之志", number, None, f"{line}\n据载守塔人与石匠已经把东西搬走。\n守塔人说今日无事可记。", T0, "c", "c", 1))
        if head:
            want.add((page, 1))

    for book, word in enumerate(words[:10]):  # numbered heads from the first page on, openings without a number
        for number in (1, 3, 5):
            put(book, number, f"第1章 {word}与钟楼 {number}")
        put(book, 6, f"第2章 {word}之用途", False)
        for number in (7, 9):
            put(book, number, f"第2章 {word}之用途　{number}")
    put(90, 1, "第1章 帆布与渡船")  # a first name without numbers is a head as well
    put(90, 3, "第1章 帆布与渡船")
    put(91, 4, "正文而已", False)
    put(91, 5, "第3章 帆布与渡船之来历", False)  # but not after a page that was read without one
    put(91, 7, "第3章 帆布与渡船之来历")
    put(91, 8, "第3章 帆巾与渡船之来历")  # a misread character makes no new chapter
    got = {(r.page_id, r.line_no) for r in scan_noise.furniture(scan_noise.read_pages(spark.createDataFrame(rows, PAGE))).where("kind = 'header'").collect()}
    assert got == want


def test_counts_of_a_large_vocabulary_are_exact(spark):
    def word(n):
        return "".join(chr(97 + n // 26**k % 26) for k in range(5))

    rows = [(p, "j", "\n".join("x " + " ".join(word(n) for n in range(line, line + 50)) for line in range(p * 5000, p * 5000 + 5000, 50))) for p in range(300)]
    rows += [(1000 + i, "j", "x abacus furnace 石匠把木桶搬到日晷旁\nx abacus furnace") for i in range(4)]
    counts = scan_noise.corpus_counts(scan_noise.read_pages(pages_of(spark, rows)))
    assert all(counts[word(n)] == 1 for n in range(0, 1_500_000, 101))
    assert not any(counts[word(n) + "q"] for n in range(20_000))
    assert (counts["furnace"], counts["abacus"], counts["木桶>"], counts["到日晷"]) == (4, 4, 4, 4)


def test_scan_noise_of_nothing(spark):
    assert scan_noise.noise(pages_of(spark, [])).count() == 0 and scan_noise.repaired(pages_of(spark, [])).count() == 0


def test_perceptron_on_held_out_pages():
    lines = [[line for line in rows] for rows in noisy_pages()]
    counts = scan_noise.Counts()
    from collections import Counter

    words, contexts = Counter(), Counter()
    for page in lines:
        scan_noise.count_page(page, words, contexts)
    counts.add(scan_noise.expanded(words, contexts))
    editor = scan_noise.Editor(counts)
    editor.train(lines[:80])
    rng, right, wrong, missed = random.Random(8), 0, 0, 0
    for page in lines[80:]:
        damaged, touched = scan_noise.damage(page, rng)
        told = {(i, at, w, r) for i, at, _, w, r, _, _ in editor.chosen(damaged)}
        right, wrong, missed = right + len(told & touched), wrong + len(told - touched), missed + len(touched - told)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.8


class Chooses(scan_noise.Editor):
    """Makes the edits that are handed in and no other."""

    def __init__(self, *edits):
        super().__init__(scan_noise.Counts(), {"b": 1.0})
        self.made = edits

    def edits(self, lines):
        return iter(self.made)


@pytest.mark.parametrize(
    ("text", "edit", "want"),
    [
        ("supermodems like modem ways here", (0, 17, "word", "modem", "modern", (), 1.0), "supermodems like modern ways here"),
        ("今日天气晴朗人日光人", (0, 7, "replace", "日", "目", (), 1.0), "今日天气晴朗人目光人"),
        ("a = b and wo=rd", (0, 2, "delete", "=", "", (), 1.0), "a  b and wo=rd"),
        ("，，　全角，日日", (0, 7, "replace", "日", "目", (), 1.0), "，，　全角，日目"),
    ],
)
def test_edits_are_made_at_their_own_place(text, edit, want):
    assert scan_noise.repaired_text(text, set(), Chooses(edit)) == want


def test_edits_that_meet_are_not_both_made():
    made = Chooses((0, 0, "word", "ab", "cd", (), 1.0), (0, 1, "delete", "b", "", (), 2.0), (0, 3, "delete", "c", "", (), 1.0))
    assert scan_noise.repaired_text("abxc", set(), made) == "ax"


def test_lines_are_joined_with_a_blank_where_words_need_one():
    editor = scan_noise.Editor(scan_noise.Counts())
    pages = [["据记载，守塔人与石匠已经把木桶搬到日晷旁，大潮之夜才清点。", "The mill stood beside the river, and the kiln was sold in 1846 to the smith."] * 20] * 4
    editor.train([scan_noise.page_lines("\n".join(page)) for page in pages])
    assert editor.blank_between("the old", "mill") and editor.blank_between("the mill,", "and")
    assert not editor.blank_between("守塔", "人与") and not editor.blank_between("记载,", "守塔")


def test_damage_marks_the_places_of_its_edits():
    rng = random.Random(3)
    for lines in noisy_pages():
        damaged, touched = scan_noise.damage(lines, rng)
        for i, at, wrong, right in touched:
            if not any(j == i and a != at and a < at + len(wrong) and at < a + len(w) for j, a, w, _ in touched):
                assert damaged[i].startswith(wrong, at) or any(j == i and at < a < at + len(wrong) for j, a, _, _ in touched)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_on_the_smallest_tables(spark, name):
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    from pathlib import Path

    import duckdb

    con = duckdb.connect()
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    told = con.sql(queries.oracle_sql()[name])
    assert df.columns == told.columns
    assert sorted(tuple(r) for r in df.collect()) == sorted(told.fetchall())
