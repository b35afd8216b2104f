import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwell.llm import pieces as op


@pytest.fixture(scope="module")
def machine():
    return op.Transducer(op.read_model(op.MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=op.MODEL)


CASES = ["", " ", "  a", "a  b ", " x\n y", "\n", "\n\n a", "▁a", "a▁▁b", "日本語テキスト😀 \x00x", "the   quick\tbrown", "a" * 40, "12345  \n  end", "x" * 50 + "      y  "]


@pytest.mark.parametrize("text", CASES)
def test_cases(machine, library, text):
    assert machine.encode(text).tolist() == library.encode(text)
    assert machine.decode(machine.encode(text)) == library.decode(library.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdehinorst ABthe▁\né日,.", max_size=60))
def test_equals_the_library(machine, library, text):
    assert machine.encode(text).tolist() == library.encode(text)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = op.encode_decode(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_ids == len(r.ids) and r.round_trip


def han(draw, n, chars=3000):
    return "".join(chr(0x4E00 + min(int(draw.paretovariate(0.6)), chars)) for _ in range(n))


def test_text_without_blanks_equals_the_library(machine, library):
    draw = random.Random(4)
    for n in (15, 16, 17, 18, 63, 64, 65, 66, 900):
        for _ in range(20):
            mixed = "".join(draw.choice([han(draw, 9), "abcdefghij", "日本語の文字", "éèü", "12345", "\u2581", "😀", "人民共和国"]) for _ in range(n // 9 + 1))
            for text in (han(draw, n), mixed, " " + mixed + "\n" + han(draw, n)):
                assert machine.encode(text).tolist() == library.encode(text), text


def test_tables_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(op, "TABLE_BYTES", 50_000)
    machine, draw = op.Transducer(op.read_model(op.MODEL)), random.Random(5)
    for _ in range(300):
        machine.encode(" ".join(han(draw, draw.choice([3, 12, 40, 500])) for _ in range(10)))
    for table in (machine.plain, machine.after_blank, machine.inner):
        assert table.held == sum(table.size(k, v) for k, v in table.items()) <= 51_000
        assert all(len(k) <= op.LONG_ASCII for k in table)


def test_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a b", 0), (2, "", 0), (3, "word " * 100_000, 0), (4, "z" * 20_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = op.encode_decode(df).collect()
    assert len(got) == 6 and all(r.round_trip for r in got)
    assert [r.n_ids for r in got[:2]] == [0, 0]
    assert op.encode_decode(df.limit(0)).count() == 0
    with_more = spark.createDataFrame([(1, "a", "s", None), (None, "b", None, 2)], "doc_id bigint, text string, source string, lang int")
    assert [(r.doc_id, r.source, r.lang) for r in op.encode_decode(with_more, keep=("source", "lang")).collect()] == [(1, "s", None), (None, None, 2)]


def hand_made(fallback):
    """A unigram model under the public character map nmt_nfkc, its pieces and scores drawn, not learnt."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.ClearField("pieces")
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = 1, fallback
    spec = proto.normalizer_spec
    spec.remove_extra_whitespaces = spec.add_dummy_prefix = spec.escape_whitespaces = True
    pieces = {"<unk>": (2, 0.0), "<s>": (3, 0.0), "</s>": (3, 0.0)}
    pieces |= {f"<0x{i:02X}>": (6, 0.0) for i in range(256)} if fallback else {}
    draw = random.Random(1)
    for _ in range(400):
        word = draw.choice("abcdet▁") + "".join(draw.choice("abcdet") for _ in range(draw.randint(0, 3)))
        pieces.setdefault(word, (1, -draw.random() * 12))
    for piece, (kind, score) in pieces.items():
        made = proto.pieces.add()
        made.piece, made.type, made.score = piece, kind, score
    return proto.SerializeToString()


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_and_character_map_equal_the_library(fallback):
    model = hand_made(fallback)
    machine, library = op.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    draw = random.Random(2)
    texts = ["", " ", "  a  b ", "\t\n", "é", "①ﬁＡ　カ゛"] + ["".join(draw.choice("abcdet  zé́①ﬁ　Ａカ゛\t\n日") for _ in range(draw.randint(0, 25))) for _ in range(1500)]
    for text in texts:
        assert machine.encode(text).tolist() == library.encode(text), text
        assert machine.decode(machine.encode(text)) == library.decode(library.encode(text)), text


def best_by_trial(machine, text):
    """Least weight over every cut of the text."""
    if not text:
        return 0.0
    cuts = [(k, machine.scores.get(text[:k], machine.least if k == 1 else None)) for k in range(1, len(text) + 1)]
    return min(best_by_trial(machine, text[k:]) - s for k, s in cuts if s is not None)


def test_the_path_is_the_lightest():
    machine, draw = op.Transducer(hand_made(True)), random.Random(3)
    for _ in range(200):
        text = "".join(draw.choice("abcdez") for _ in range(draw.randint(1, 9)))
        path = machine.lightest(text)
        assert "".join(path) == text
        assert abs(sum(-machine.scores.get(p, machine.least) for p in path) - best_by_trial(machine, text)) < 1e-4


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(hand_made(True))
    proto.trainer_spec.treat_whitespace_as_suffix = True
    with pytest.raises(ValueError):
        op.Transducer(proto.SerializeToString())


def test_a_stretch_is_read_once_for_all_its_words(library, monkeypatch):
    straight, draw, seen = op.Transducer.straight, random.Random(6), []
    monkeypatch.setattr(op.Transducer, "straight", lambda self, text: seen.append(text) or straight(self, text))
    fresh = op.Transducer(op.read_model(op.MODEL))
    stems = ["".join(draw.choice(["th", "an", "ti", "on", "ble", "re"]) for _ in range(4)) for _ in range(20)]
    ends = ["".join(draw.choice("#%&$*") for _ in range(6)) for _ in range(50)]
    text = " ".join(a + b for a in stems for b in ends)
    assert fresh.encode(text).tolist() == library.encode(text)
    assert len(seen) == len(set(seen)) < 20 + 50 * 6


def test_texts_in_groups_equal_the_library(machine, library, monkeypatch):
    draw = random.Random(7)
    texts = ["", "a b\n", "", " ", *["".join(draw.choice(["the ", "mot", "\n", "  ", "é", "日本", "😀", "#&", "▁", "12"]) for _ in range(draw.randint(0, 40))) for _ in range(60)], ""]
    want = [library.encode(x) for x in texts]
    for group in (1_000_000, 7, 1):  # texts are cut in blocks of so many characters
        monkeypatch.setattr(op, "GROUP", group)
        ids, sizes = machine.encode_all(texts)
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [y for x in want for y in x]
    ids, sizes = machine.encode_all(["", ""])
    assert len(ids) == 0 and sizes.tolist() == [0, 0]


def merge_model(seed):
    """A merge model whose pieces and scores are drawn: scores tie, and some pieces are never made by merging."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(op.read_model(op.MODEL))
    fixed = [p for p in proto.pieces if p.type != 1]
    proto.ClearField("pieces")
    for piece in fixed:
        proto.pieces.add().CopyFrom(piece)
    draw = random.Random(seed)
    words = {draw.choice("abc▁") + "".join(draw.choice("abc") for _ in range(draw.randint(0, 4))) for _ in range(60)}
    for word in sorted(words):
        made = proto.pieces.add()
        made.piece, made.type, made.score = word, 1, -float(draw.randint(1, 20))
    return proto.SerializeToString()


@pytest.mark.parametrize("seed", range(6))
def test_merge_models_with_drawn_scores_equal_the_library(seed):
    model = merge_model(seed)
    machine, library = op.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    draw = random.Random(seed + 100)
    for _ in range(500):
        text = "".join(draw.choice("abcabcabc d") for _ in range(draw.randint(0, 14)))
        assert machine.encode(text).tolist() == library.encode(text), text


def test_the_weight_of_a_pair_is_what_merging_says(machine):
    draw = random.Random(8)
    for made in (machine, op.Transducer(merge_model(1))):
        several = sorted(made.ids)
        for _ in range(3000):
            left, right = draw.choice(several), draw.choice(several)
            *_, (parts, _) = made.merging(left + right)
            assert made.joins(made.ids[left], made.ids[right]) == (parts == [left, right]), (left, right)
