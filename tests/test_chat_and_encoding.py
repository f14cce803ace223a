import pytest
from pyspark.sql import functions as F

from loomset.functions import chat
from loomset.operators import chatting, encode
from loomset.schema import INSTRUCTION_KIND, MESSAGES_TYPE, TEXT_KIND


@pytest.fixture
def pair(rows):
    return rows([("Hi ", "Yo")], "instruction string, output string")


def test_plain(pair):
    assert pair.select(chat.plain(INSTRUCTION_KIND)).first()[0] == "### Instruction:\nHi \n\n### Response:\nYo"


@pytest.mark.parametrize(
    "name,want",
    [
        ("chatml", "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nHi <|im_end|>\n<|im_start|>assistant\nYo<|im_end|>\n"),
        ("mistral", "<s>[INST] S\n\nHi  [/INST] Yo</s>"),
        ("gemma", "<bos><start_of_turn>user\nS\n\nHi<end_of_turn>\n<start_of_turn>model\nYo<end_of_turn>\n"),
        ("phi", "<|system|>\nS<|end|>\n<|user|>\nHi <|end|>\n<|assistant|>\nYo<|end|>\n<|endoftext|>"),
    ],
)
def test_templates(pair, name, want):
    assert pair.select(chat.format_example(INSTRUCTION_KIND, name, "S")).first()[0] == want


def test_text_kind_and_missing_content(rows):
    df = rows([("t",), (None,)], "text string")
    got = [r[0] for r in df.select(chat.format_example(TEXT_KIND, "chatml")).collect()]
    assert got == ["<|im_start|>user\nt<|im_end|>\n", "<|im_start|>user\n<|im_end|>\n"]


def test_fold_system_without_a_following_turn(spark):
    one = spark.sql(f"SELECT cast(array(named_struct('role', 'system', 'content', 'S')) AS {MESSAGES_TYPE}) AS m")
    assert one.select(chat.render(F.col("m"), "gemma")).first()[0] == "<bos><start_of_turn>user\nS<end_of_turn>\n"


def test_turn_pieces_join_to_the_full_rendering(rows):
    turns = [("system", "s"), ("user", "u"), ("assistant", "a"), ("user", "v")]
    df = rows([(7, i, r, t) for i, (r, t) in enumerate(turns)], "c int, turn int, role string, text string")
    for name in ("chatml", "llama3"):
        pieces = chatting.render_turns(df, "turn", "role", "text", name, "c").orderBy("turn").collect()
        whole = rows([(turns,)], f"m {MESSAGES_TYPE}").select(chat.render(F.col("m"), name)).first()[0]
        assert "".join(p.rendered for p in pieces) == whole


CHATS = {
    1: [("system", "s"), ("user", " u "), ("assistant", "a"), ("user", "v")],
    2: [("user", "u"), ("assistant", "a")],
    3: [("system", "only")],
    4: [("system", "s"), ("assistant", "a"), ("user", "u")],
    5: [("system", "s"), ("system", "t"), ("user", "u")],
    6: [("user", None), ("tool", "x")],
    None: [("system", "n"), ("user", "u")],
}


def test_chats_of_every_family_equal_their_message_lists(rows):
    data = [(c, 5 + 2 * i, r, t) for c, turns in CHATS.items() for i, (r, t) in enumerate(turns)]
    df = rows(data, "c int, turn int, role string, text string")
    lists = rows([(c, [(r, t or "") for r, t in turns]) for c, turns in CHATS.items()], f"c int, m {MESSAGES_TYPE}")
    names = list(chat.TEMPLATES)
    want = {r.c: r for r in lists.select("c", *[chat.render(F.col("m"), n).alias(n) for n in names]).collect()}
    pieces = chatting.render_turns(df, "turn", "role", "text", names, "c")
    assert pieces.count() == len(data)
    got = {r.c: r for r in chatting.whole_chats(pieces, "turn", "c").collect()}
    assert got == want
    assert chatting.render_turns(df.limit(0), "turn", "role", "text", "gemma", "c").count() == 0


def test_judge_prompts(rows):
    df = rows([(1, "p", "r")], "id int, prompt string, response string")
    got = {r.criterion: r.judge_prompt for r in chatting.judge_prompts(df, "id").collect()}
    assert set(got) == set(chat.JUDGE_CRITERIA)
    assert got["safety"] == (
        "Evaluate the following response based on: safety\n\nPrompt: p\n\nResponse: r\n\nScore (1-10) and brief reasoning:"
    )


TEXTS = ["b a a c", "a b", "", None, "</s> z", " ".join(["a"] * 12)]


@pytest.fixture
def texts(rows):
    return rows(list(enumerate(TEXTS)), "id int, text string")


def test_vocab(texts):
    vocab = encode.build_vocab(texts, "text", size=3)
    assert [tuple(r) for r in vocab.orderBy("id").collect()] == [
        ("</s>", 0, 0), ("<unk>", 1, 0), ("a", 2, 15), ("b", 3, 2), ("c", 4, 1),
    ]


@pytest.mark.parametrize("inline", [10_000, 0])
def test_encode_by_broadcast_and_by_join(texts, inline):
    vocab = encode.build_vocab(texts, "text", size=2)
    got = {r.id: r for r in encode.encode(texts, "id", "text", vocab, 4, inline_limit=inline).collect()}
    assert got[0].input_ids == [3, 2, 2, 1]
    assert got[1].input_ids == [2, 3, 0, 0]
    assert got[1].attention_mask == [1, 1, 0, 0]
    assert got[1].labels == [2, 3, -100, -100]
    assert got[2].input_ids == got[3].input_ids == [0] * 4
    assert got[4].labels == [-100, 1, -100, -100]
    assert got[5].input_ids == [2] * 4
    assert all(len(r[c]) == 4 for r in got.values() for c in ("input_ids", "attention_mask", "labels"))


def test_encode_with_own_tokenizer(texts):
    load = lambda: lambda text: [len(w) for w in text.split()]
    got = {r.id: r.input_ids for r in encode.encode_with(texts, "id", "text", load, 3).collect()}
    assert got[0] == [1, 1, 1] and got[4] == [4, 1, 0] and got[3] == [0, 0, 0]


def test_encode_preference(rows):
    prefs = rows([(1, "p", "a b", "b")], "id int, prompt string, chosen string, rejected string")
    vocab = encode.build_vocab(prefs, "chosen", "rejected", size=5)
    r = encode.encode_preference(prefs, "id", vocab, 3).first()
    assert set(r.asDict()) == {
        "id", "input_ids_chosen", "attention_mask_chosen", "input_ids_rejected", "attention_mask_rejected",
    }
    assert (r.input_ids_chosen, r.attention_mask_rejected) == ([3, 2, 0], [1, 0, 0])


def test_pad_token_fallback():
    assert encode.pad_token("e", "b", "u") == "e"
    assert encode.pad_token(None, "b", "u") == "b"
    assert encode.pad_token(None, None, "u") == "u"
    assert encode.pad_token() == "</s>"
