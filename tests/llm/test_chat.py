import hashlib
import random

import pytest

from podium.llm import chat

BITS = ["</s>", "[INST]", "<|end|>", "<|", "\\", "\\\\", "a", "é😀", "\n", "<", "|", "<|text|>", "[", "<<SYS>>", "s>", "</", " "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), sha(said), len(loss), sha(loss)


@pytest.mark.parametrize("seed", range(20))
def test_escaping_is_reversible_and_hides_control_strings(seed):
    r = random.Random(seed)
    pattern = chat.control_pattern(chat.CONTROL)
    for _ in range(200):
        text = "".join(r.choice(BITS) for _ in range(r.randrange(14)))
        escaped = chat.escape(text, pattern)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in chat.CONTROL)


def test_reading_back_in_parts_of_any_size(monkeypatch):
    r = random.Random(1)
    render = chat.ChatTemplate().compiled()
    for _ in range(400):
        monkeypatch.setattr(chat, "PART_CHARS", r.choice([1, 2, 3, 7, 1000]))
        turns = [(r.choice(["user", "assistant", "x\\<|"]), "".join(r.choice(BITS) for _ in range(r.randrange(12)))) for _ in range(r.randrange(4))]
        reader = chat.Reader()
        for part, loss in chat.parts_of(render({"role": a, "text": b} for a, b in turns)):
            reader.feed(part, loss)
        reader.close()
        assert (reader.n_turns, reader.turns.hexdigest(), reader.n_loss, reader.loss.hexdigest()) == expected(turns)


def test_constants_are_folded():
    tree = chat.ChatTemplate("{% set a = 'x' ~ 'y' %}{% if a == 'xy' and not false %}{{ a | upper }}{% else %}no{% endif %}!").tree()
    assert tree[-1] == chat.Output(chat.Const("XY!"))
    assert "".join(t for t, _ in chat.ChatTemplate("{% set a = 1 %}{{ a }}{# c #}{{ none }}{{ true }}").compiled()([])) == "1true"


def test_loops_branches_and_generation():
    source = (
        "{% for m in messages %}{% if loop.first %}<s>{% elif m.role == 'b' %}-{% else %}+{% endif %}"
        "{% generation %}{{ loop.index }}{{ m['text'] | trim | length }}{% endgeneration %}{% if loop.last %}</s>{% endif %}{% endfor %}"
    )
    out = list(chat.ChatTemplate(source).compiled()([{"role": "a", "text": " x "}, {"role": "b", "text": "yy"}, {"role": "c", "text": ""}]))
    assert "".join(t for t, _ in out) == "<s>11-22+30</s>"
    assert "".join(t for t, loss in out if loss) == "112230"


def test_a_set_inside_a_loop_is_no_constant():
    source = "{% set a = 'x' %}{% for m in messages %}{{ a }}{% set a = m.text %}{% endfor %}{{ a }}"
    assert "".join(t for t, _ in chat.ChatTemplate(source).compiled()([{"role": "", "text": "1"}, {"role": "", "text": "2"}])) == "x12"


@pytest.mark.parametrize(
    "source",
    [
        "{{ m.__class__ }}", "{{ open('x') }}", "{% for x in other %}{% endfor %}", "{% if a %}", "{{ 'a' | eval }}", "{% set messages = 1 %}", "{{ a",
        "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% for m in messages %}{% endfor %}" * 2, "{% endfor %}",
        "{{ " + "(" * 100 + "1" + ")" * 100 + " }}", "x" * 20_001,
    ],
)
def test_the_sandbox_refuses(source):
    with pytest.raises(chat.TemplateError):
        chat.ChatTemplate(source).compiled()


def test_tables(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "<|end|>"), (None, None, "assistant", "n"), (None, 3, "assistant", "m"),
        (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (2**60 + 1, 0, "assistant", "x" * 200_000),
    ]
    turns = spark.createDataFrame([(*r, "own") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")
    got = {r.conv_id: r for r in chat.read_back(chat.render_conversations(turns)).collect()}
    by_id = {1: [("user", None), ("assistant", "b")], 2: [(None, "<|end|>")], None: [("assistant", "n"), ("assistant", "m")],
             3: [("assistant", "same")] * 2, 2**60 + 1: [("assistant", "x" * 200_000)]}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == {k: expected(v) for k, v in by_id.items()}
    whole = {r.conv_id: r for r in chat.formatted_conversations(turns).collect()}
    assert len(whole[1].formatted) == got[1].formatted_chars
    assert [whole[3].formatted[s.start : s.end] for s in whole[3].loss_spans] == ["same", "same"]
    assert chat.read_back(chat.render_conversations(turns.where("false"))).count() == 0
