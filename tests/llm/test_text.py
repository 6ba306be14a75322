"""Tokens against public encoders, and sentences of many scripts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetrail.llm import bpe, sentences


@pytest.fixture(scope="module")
def coder():
    return bpe.Tokenizer.load("byte_bpe_50k", bpe.VOCABULARY_DIR)


@pytest.fixture(scope="module")
def public(coder):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=coder.ranks, special_tokens={})


TEXTS = ["", " ", "\n\n \t", "<|endoftext|> stays text", "naïve café 東京 🧬👩🏽‍🔬", "a" * 5000, "don't we'll I'm", "x" + " " * 300 + "y", "ﷺ𝔘𝔫𝔦", "\x00\x1b[0m"]


@pytest.mark.parametrize("text", TEXTS)
def test_tokens_of_odd_texts(coder, public, text):
    ids = coder.encode(text)
    assert ids == public.encode_ordinary(text) and coder.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_tokens_of_any_text(text):
    coder = bpe.Tokenizer.load("byte_bpe_50k", bpe.VOCABULARY_DIR)
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert coder.decode(coder.encode(text)) == text
    piece = text.encode()
    assert coder.transducer.encode(piece) == [coder.ranks[t] for t in coder.transducer.merged(piece)]


def test_transducer_is_lazy_and_starts_afresh(coder, monkeypatch):
    t = bpe.MergeTransducer(coder.ranks)
    assert t.encode(b"transducer") == coder.transducer.encode(b"transducer") and len(t._keys) < 30
    monkeypatch.setattr(bpe, "STATE_MEMORY", 3)
    assert t.encode(b"another word") == coder.transducer.encode(b"another word")


def test_decoding_in_pieces():
    rng = random.Random(0)
    for _ in range(500):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF]) for _ in range(rng.randint(0, 9)))
        d = bpe.Utf8Decoder()
        assert "".join(d.feed(data[i : i + 1]) for i in range(len(data))) + d.close() == data.decode("utf-8", "replace")


def test_columns(spark, public):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 6), (3, "", 7), (4, "  ", 8)], "doc_id bigint, text string, ids int")
    rows = {r["doc_id"]: r["ids"] for r in bpe.encode_column(df, "text", ["doc_id"]).collect()}
    assert rows == {1: public.encode_ordinary("hello world"), 2: [], 3: [], 4: public.encode_ordinary("  ")}
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.count_column(df, "text", ["doc_id"]).collect()}
    assert n == {k: len(v) for k, v in rows.items()}
    back = bpe.decode_column(bpe.encode_column(df, "text", ["doc_id"]), "ids", ["doc_id"]).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {1: "hello world", 2: "", 3: "", 4: "  "}
    assert bpe.encode_column(df.limit(0), "text", ["doc_id"]).count() == 0


# --- sentences: units are divided by | ---

CASES = [
    "We kept water, ions, etc.| The box measures 50.5 x 58.0 nm, vs. 52.70 nm before.",
    "See Fig. 3 (cf. Eq. (7)) and Suppl. Fig. S6.| It came back at 4 p.m. Tuesday and finished.| It left at 11 p.m.| They wrote.",
    "The mirror in the U.S. was slow.| Most of it is in the U.S.| Half is not.",
    "\"Is it stable?\" asked L. Osk slowly.| \"Is it stable?\" Dr. Zorlin asked.| \"It stopped. I restarted it,\" wrote Prof. Drunn.",
    "They wrote, “We can’t reproduce it… The barostat looks different.”| By contrast: no.",
    "The message says \"Bad contact. Stopping now.\" and nothing else.| Did Osk say \"it converged\"?| Every replica did.",
    "(The first 22 ns were discarded.)| The check (is it finite?) failed.| Stop!| N.B. the run ended.",
    "No idea…| This lag time is fine.| The job was waiting … and then it started.| It never left state 453...| The list agrees.",
    "It ran at 300 K.| The contact of ostwenase B.| It agrees with node 5.| tICA puts it first.| mdquill stopped.| pH was set.| .pdb files were skipped.",
    "Runs III. and IV. included, all is kept.| Call `msm.fit()` first.| Data are at https://runs.example/p/10.html now.",
    "The copy did not.|The box came out larger!|Our copy gave 5 ns.|(The first were lost.)|A run of v2.1.|It works: msm.fit() and N.B. the rest too.",
    "Der 3. Lauf von TRN4 war gut.| Siehe Ref. 9.| Seit gestern ist Lauf 3.|Das war es.",
    "कृपया run1.h5 को न मिटाएँ!| villorin का मॉडल रुक गया।",
    "Osk answered: \"Use the longer lag time.\"| J. Osk answered: \"No.\"| (It was discarded.)| They wrote, “It ran.”| L. Osk answered: \"Yes.\"",
    "Es fehlen z. B. die Ionen, d. h. nichts.| „Läuft es noch?“, fragte Osk am Abend.| Osk schrieb: „Bitte neu starten.“| Wir behalten Ionen usw.| Das war am 4. März so.",
    "M. Drunn a écrit : « Il faut relancer. »| Ne touchez pas à frame2.xtc !| « Ça tourne encore ? » demanda M. Osk le soir.| Le nœud… il avait disparu, p. ex. hier.",
    "«¿Sigue en marcha?», preguntó la Dra. Osk.| ¡No borre nada!| Dio 2 ns, p. ej. en run1.h5.",
    "Мы оставили воду, ионы и т. д.| Шаг равен 2 фс, т. е. меньше.| «Расчёт идёт?» — спросил оператор.| Всего 52 тыс. кадров, см. рис. 3.",
    "Γιατί σταμάτησε ο υπολογισμός;| Κρατήσαμε ιόντα, κ.λπ.| Βλ. σχ. 6, π.χ. εδώ.",
    "节点……突然消失了。|日志写道：“接触错误。停止。”，然后什么也没有。|操作员回答：“请重新启动。”|步长为2 fs。|“还在运行吗？”操作员问。|真的吗？！|（前2 ns已舍弃。）|总共有8帧……。",
    "「まだ動いていますか？」と担当者が尋ねた。|本当ですか｡|全部で3フレームある．|書庫は止まった。",
    "담당자는 \"다시 시작하세요.\"라고 답했다.| 왜 멈췄습니까?| 3.5% 늘었다.",
    "लॉग में लिखा है “त्रुटि। रुक रहा है।” और कुछ नहीं।| डॉ. Osk के अनुसार ठीक है।| क्या यह चालू है?",
    "هل ما زال العمل جاريا؟| كتب السجل «خطأ. توقف.» ولا شيء.| اختفت العقدة… فجأة.",
    "لاگ میں لکھا ہے ”خرابی۔ رک رہا ہے۔“ اور کچھ نہیں۔| کیا یہ چل رہا ہے؟",
    "Տես նկ. 578 և աղ. 283։| Մի՛ ջնջեք ֆայլը։",
    "ሞዴሉ ቆመ።| ስራው ለምን ቆመ፧| እባክዎ አይሰርዙ!",
    "สถานะที่ 299 พบได้น้อยมาก| เมทริกซ์ลู่เข้า| ใช้ frame1.xtc นี้| กล่องว่างเปล่า",
]


@pytest.mark.parametrize("case", CASES)
def test_sentences(case):
    parts = case.split("|")
    text, want = "".join(parts), [p.strip() for p in parts]
    assert [text[a:b] for a, b in sentences.spans(text)] == want


def test_blocks():
    text = "## What is this? Yes\r\n\r\nOne line\r\nand its rest.\r\n \r\n- First item. More of it.\r\n- Second\r\n\r\n1. A b.\r\n2. C d.\r\n\r\n[2031-01-02 10:00:00.1] INFO loaded top.pdb. 447 atoms\r\n2031-01-02 10:00:00.1 WARN bad contact! retrying...\r\n"
    got = [text[a:b] for a, b in sentences.spans(text)]
    assert got == [
        "## What is this? Yes", "One line\r\nand its rest.", "- First item.", "More of it.", "- Second", "1. A b.", "2. C d.",
        "[2031-01-02 10:00:00.1] INFO loaded top.pdb. 447 atoms", "2031-01-02 10:00:00.1 WARN bad contact! retrying...",
    ]


def test_a_bracket_that_never_closes_ends_with_its_block():
    text = "Open (here. Then more.\n\nNext one. Last."
    assert [text[a:b] for a, b in sentences.spans(text)] == ["Open (here.", "Then more.", "Next one.", "Last."]


def in_pieces(text: str, places: list[int]) -> list[tuple[int, int]]:
    """The sentences of a text read in pieces, each by the state that the functions before it give."""
    cuts = sorted({0, *(sentences.settle(text, p) for p in places), len(text)})
    ranges = list(zip(cuts, cuts[1:]))
    beyond, ahead = [], ""
    for a, b in reversed(ranges):
        beyond.append(ahead)
        marks, blank = sentences.closed_ahead(text, a, b)
        ahead = marks + ("" if blank else ahead)
    beyond.reverse()
    state, so_far, found = sentences.START, None, [0]
    for (a, b), ahead in zip(ranges, beyond):
        found += sentences.read(text, state, a, b, ahead)[0]
        f = sentences.PieceFunction.read(sentences.transition(text, a, b, ahead).write())
        so_far = f if so_far is None else so_far.then(f)
        state = f(state)
        assert so_far(sentences.START) == state == sentences.read(text, sentences.START, 0, b, ahead)[1]
    return sentences.trimmed_spans(text, sorted({*found, len(text)}))


#: Pieces of texts that open marks after a colon, a comma and within one another.
BITS = [
    'He said: "', 'she asked, "', "(as we ", 'it (he said, "go. Now") went', ". ", "? ", "! ", "... ", "… ", '"', ")", "' ", "x.' ", "\n", "\n\n", "   ", "\t", "- item ", "\n- item one. ", "\n# Head\n",
    "Dr. Smith ", "e.g. this ", "5.3 nm ", "word ", "Next ", "« non. »", "「好。」", "สวัสดี ครับ ", "“It is. late”", "„so.“", "[2024-01-02 10:11:12] log. line\n", "z. B. ", "am 3. Mai ", 'mid, "(a: "b. C" d)" E. ', "।",
]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(BITS), min_size=1, max_size=40), st.integers(20, 90))
def test_any_chunk_gives_what_the_whole_gives(bits, chunk):
    text = "".join(bits)
    assert in_pieces(text, list(range(chunk, len(text), chunk))) == sentences.spans(text)


def test_partners_far_away():
    far = "(" + "Much goes on here. " * 500 + "and ends)."
    assert len(sentences.spans(far + " Next one.")) == 2 and len(sentences.spans(far.replace(")", "") + " Next one.")) == 502
    assert in_pieces(far + " Next one.", list(range(700, len(far), 700))) == sentences.spans(far + " Next one.")


NESTED = [
    'He came (as she said: "It is late. We go home now. Really, I say." and then left). It was late. ' * 3,
    'They wrote (he said, "We ran it. It failed." Then left.) and went. More follows. End.',
    "Log: “Start (see «the ‹old› note. Really?» here. So.) and stop.” Then more. End.",
    "A (b [c {d} “e. F.” g.] h. I) j. Next, “(one [two] three.)” Last.",
]


@pytest.mark.parametrize("text", NESTED)
def test_pieces_at_every_offset(text):
    for a in range(1, len(text), 5):
        for size in (23, len(text)):
            assert in_pieces(text, list(range(a, len(text), size))) == sentences.spans(text)


@pytest.mark.parametrize("chunk", [20, 60])
def test_nested_quotations_in_pieces_in_spark(spark, chunk, monkeypatch):
    df = spark.createDataFrame(list(enumerate(NESTED)), "doc_id bigint, text string")
    whole = sorted((i, *s) for i, text in enumerate(NESTED) for s in sentences.spans(text))
    monkeypatch.setattr(sentences, "FAN", 3)
    got = sentences.sentences(df.unionByName(df).withColumn("low", sentences.F.lit(1)), "doc_id", "text", chunk=chunk)
    assert sorted(tuple(r) for r in got.collect()) == sorted(whole * 2)


def test_long_texts_in_spark(spark):
    long = "\n\n".join(c.replace("|", "") for c in CASES)
    df = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, " \n "), (5, CASES[0].replace("|", ""))], "doc_id bigint, text string").withColumn("low", sentences.F.lit(1))
    whole = {tuple(r) for r in sentences.sentences(df, "doc_id", "text").collect()}
    pieces = {tuple(r) for r in sentences.sentences(df, "doc_id", "text", chunk=400).collect()}
    assert whole == pieces and {r[0] for r in whole} == {1, 5}


def test_empty_tables_and_very_long_texts(spark, coder, public, monkeypatch):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sentences.sentences(df, "doc_id", "text").count() == 0 and bpe.count_column(df, "text", ["doc_id"]).count() == 0
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    text = "words of a long text, again and again. " * 50
    assert coder.encode(text) == public.encode_ordinary(text)
    big = "One sentence here. " * 20_000
    assert len(sentences.spans(big)) == 20_000
