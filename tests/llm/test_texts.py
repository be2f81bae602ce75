import random

import pytest

from quillmesh.llm import encoding, leakage, splitting, stuffing

TOKENIZER = pytest.importorskip("tokenizers")


def docs(spark, texts, schema="doc_id long, text string, word string, ids string"):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], schema)


def random_text(rng, n):
    words = ["oak", "the", "barrel", "cellar", "été", "日本", "'s", "12", "3.5", "\n\n", "  ", "Ünder", "🍷", "don't"]
    return " ".join(rng.choice(words) for _ in range(n))


def test_pieces(spark):
    rng = random.Random(1)
    texts = ["short", None, "", "x" * 9000, "word " * 3000, random_text(rng, 4000), "A sentence here. " * 400, "para\n\n" * 900, "a" * 2003, "a" * 2004]
    rows = [(i, t, "h", 3, 1) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "id long, content string, heading string, page_num int, piece int")
    out = {}
    for r in splitting.split_oversized(chunks).collect():
        out.setdefault(r.chunk_id, []).append(r)
    assert set(out) == {i for i, t in enumerate(texts) if t and max(1, len(t) // 4) > 500}
    for i, pieces in out.items():
        pieces.sort(key=lambda p: p.piece)
        end = 0
        for p in pieces:
            assert texts[i][p.start : p.start + len(p.content)] == p.content and p.start <= end and p.start >= end - 200
            assert p.token_count == max(1, len(p.content) // 4) <= 500 and p.n_pieces == len(pieces) and (p.heading, p.page_num) == ("h", 3)
            end = p.start + len(p.content)
        assert end == len(texts[i])
    assert all(p.content.endswith(". ") for p in out[6][:-1]) and all(p.content.endswith("\n\n") for p in out[7][:-1])


def test_overlap_is_as_large_as_the_words_allow():
    rng = random.Random(8)
    for _ in range(60):
        words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", "", ",", ".", "\n\n"]) for _ in range(900)]
        spans = splitting.cut_points(" ".join(words), 500, 50)
        overlaps = [b - c for (_, b), (c, _) in zip(spans, spans[1:])]
        assert overlaps and all(200 - 16 <= o <= 200 for o in overlaps)
    assert [b - c for (_, b), (c, _) in zip(*(lambda s: (s, s[1:]))(splitting.cut_points("x" * 9_000, 500, 50)))] == [200] * 4


def test_encoding_round_trip(spark):
    rng = random.Random(2)
    texts = [random_text(rng, rng.randrange(1, 80)) for _ in range(60)] + [None, "", " ", "<|endoftext|>", "a" * 20_000, "oak", "oak", "x\u0000 12", "ꙮ ա1 ﻿"]
    df = docs(spark, texts)
    got = {r.doc_id: r.ids for r in encoding.encode_corpus(df).collect()}
    tokenizer = TOKENIZER.Tokenizer.from_file(encoding.TOKENIZER)
    tokenizer.encode_special_tokens = True
    assert got == {i: e.ids for i, e in enumerate(tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    back = {r.doc_id: r.text for r in encoding.decode_corpus(spark.createDataFrame(list(got.items()), "doc_id long, ids array<int>")).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encoding.encode_corpus(df.where("false")).count() == 0


def test_leakage_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for i in range(30)]
    items += [(90, items[0][1]), (91, None), (92, ""), (93, items[1][1] + " tail")]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(50)]
        source = rng.choice(items[:30])[1].split()
        cut = rng.randrange(0, max(1, len(source) - 12))
        texts.append(" ".join([*words, *source[cut : cut + rng.randrange(8, 14)], *words[:7]]).upper().replace(" ", rng.choice([" ", ", ", "\n"])))
    texts += [None, "", "x" * 1000]
    grams = {}
    for i, t in items:
        w = (t or "").split()
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = set()
    for d, t in enumerate(texts):
        w = leakage._words(t or "")
        for k in range(len(w) - 9):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 10]), ())}
    df, item_df = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    spans = leakage.leaked_spans(df, item_df)
    assert {(r.doc_id, r.item_id) for r in spans.collect()} == want and want
    cleaned = {r.doc_id: r for r in leakage.clean_documents(df, spans).collect()}
    assert len(cleaned) == len(texts)
    again = leakage.leaked_spans(spark.createDataFrame([(k, r.text) for k, r in cleaned.items()], "doc_id long, text string"), item_df)
    hit = {d for d, _ in want}
    assert all(cleaned[d].n_spans > 0 and len(cleaned[d].text) < len(texts[d]) for d in hit) and all(cleaned[d].text == texts[d] for d in range(len(texts)) if d not in hit)
    assert again.count() == 0
    assert leakage.leaked_spans(df, item_df.where("false")).count() == 0


def test_leakage_in_many_blocks_and_shares(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(leakage, "TASK_CHARS", 2_000)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(30))) for i in range(60)]
    texts = [" ".join([*(f"x{rng.randrange(400)}" for _ in range(20)), *items[rng.randrange(60) if k % 3 else 5][1].split()[4:17], "end"]) for k in range(120)]
    df, item_df = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **k: sorted(tuple(r) for r in leakage.leaked_spans(df, item_df, **k).collect())
    few, many = rows(), rows(block_words=100)
    assert few == many and len({d for d, *_ in few}) == 120


def test_stuffed_pages(spark):
    sentence = "The old barrel stood behind the house, and we opened it after the rain. "
    texts = [
        "rum cheap Windport\nrum best Fennhaven\ngin deal Molenmere\n" * 12,
        sentence + "opener top barrel cooler best gin shelf offer cooler shelf sale barrel shelf shipping gin cooler store " * 6,
        "\n".join(f"- [cheap rum {k}](https://deal.example/rum/{k})" for k in range(20)),
        sentence * 12,
        "\n".join(f"- [Note {k}](https://notes.example/{k}): We opened the barrel in the evening after the concert." for k in range(20)),
        "- [x] call the baker in the morning\n- [ ] bring the oak to the cellar\n" * 10,
        "祖母は雨の中で手紙の横に香っていた。最後の樽は橋の向こうで眠っていた。" * 12,
        "rum cheap rum", "", None, "a" * 300,
        sentence * 5 + "top rum best rum " * 10,
    ]
    assert {r.doc_id for r in stuffing.stuffed_pages(docs(spark, texts)).collect()} == {0, 1, 2}


PROSE = {
    "ru": "Сегодня утром мы долго шли вдоль реки и говорили о старом доме, который дед построил после войны. В саду уже цвели яблони, и сосед помогал нам чинить забор. Вечером пришла тётя с пирогом, мы пили чай на веранде и слушали, как дождь стучит по крыше. Мне казалось, что лето никогда не кончится, но в воздухе уже пахло осенью.",
    "pl": "Dzisiaj rano poszliśmy nad rzekę i długo rozmawialiśmy o starym domu, który dziadek zbudował po wojnie. W ogrodzie kwitły już jabłonie, a sąsiad pomagał nam naprawiać płot. Wieczorem przyszła ciotka z ciastem, piliśmy herbatę na werandzie i słuchaliśmy deszczu. Wydawało mi się, że lato nigdy się nie skończy.",
    "fi": "Tänä aamuna kävelimme pitkään joen rantaa ja puhuimme vanhasta talosta, jonka isoisä rakensi sodan jälkeen. Puutarhassa omenapuut kukkivat jo, ja naapuri auttoi meitä korjaamaan aitaa. Illalla täti tuli piirakan kanssa, joimme teetä kuistilla ja kuuntelimme sateen ääntä katolla.",
}


def test_prose_of_unknown_languages_is_not_stuffed_but_stuffing_is(spark):
    rng = random.Random(6)
    words = ["дешёвый", "виски", "купить", "онлайн", "скидка", "магазин", "лучший"]
    stuffed = " ".join(rng.choice(words) for _ in range(80))
    texts = [*PROSE.values(), *(p + "\n" + q for p in PROSE.values() for q in PROSE.values() if p != q), stuffed, "a" * 500, "#" * 300, "\u2028" * 400]
    assert {r.doc_id for r in stuffing.stuffed_pages(docs(spark, texts)).collect()} == {9}


def test_a_very_long_page_of_prose_and_of_keywords(spark):
    rng = random.Random(7)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in ("an", "el", "ir", "ost") for c in ("ta", "mo", "lin", "der", "gu")]
    prose = ". ".join(" ".join(["the", rng.choice(words), "and", *rng.sample(words, 3), "in", "the", rng.choice(words)]) for _ in range(6_000))
    keywords = " ".join(rng.choice(words[:12]) for _ in range(40_000))
    assert {r.doc_id for r in stuffing.stuffed_pages(docs(spark, [prose, keywords])).collect()} == {1}


def test_repeated_signs_against_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        t = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 60)))
        covered = set()
        for n in range(4, len(t)):
            for k in range(len(t) - n + 1):
                if t.find(t[k : k + n], 0) != t.rfind(t[k : k + n]):
                    covered |= set(range(k, k + n))
        assert stuffing.repeated_signs(t, 4).count(1) == len(covered)


def test_numbers_of_different_lengths_repeat_each_other():
    assert stuffing.repeated_words("oak 12345 rum 7").count(1) == 5 and stuffing.repeated_words("a 7 b 9").count(1) == 0


def test_repeated_words_against_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        ws = [rng.choice(["oak", "rum", "a", "ale", "".join(rng.choices("bcdfg", k=6))]) for _ in range(rng.randrange(1, 40))]
        text, covered = " ".join(ws), set()
        at = [sum(map(len, ws[:k])) + k for k in range(len(ws))]
        for n in range(1, len(ws)):
            for k in range(len(ws) - n + 1):
                end = at[k + n - 1] + len(ws[k + n - 1])
                if end - at[k] >= 4 and any(ws[j : j + n] == ws[k : k + n] for j in range(len(ws) - n + 1) if j != k):
                    covered |= set(range(at[k], end))
        assert stuffing.repeated_words(text).count(1) == len(covered)


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    kinds = {}
    for name, splitter, normalizer in (("none", None, None), ("lower", pre_tokenizers.ByteLevel(add_prefix_space=False), normalizers.Lowercase()), ("digits", pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=False)]), None)):
        tokenizer = Tokenizer(models.BPE())
        if splitter is not None:
            tokenizer.pre_tokenizer = splitter
        if normalizer is not None:
            tokenizer.normalizer = normalizer
        kinds[name] = str(tmp_path / f"{name}.json")
        tokenizer.save(kinds[name])
    for name in ("none", "lower"):
        with pytest.raises(ValueError, match="word by word"):
            encoding._Splitter(kinds[name])
    other = encoding._Splitter(kinds["digits"])
    assert not other.fast and "".join(other.words("a 123")) == "a 123" and "123" not in other.words("a 123")
