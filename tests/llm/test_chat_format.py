"""Quotation linking against a plain walk over each conversation."""

import random

from lodestone.llm import chat_format, queries

SF = "/root/testdata/sf0.001"


def plain_parse(text):
    """Letter by letter: the own lines of a message, and its quoted passages as (depth, lines)."""
    own, quotes, before = [], [], 0
    for line in text.split("\n"):
        k = depth = 0
        while k < len(line) and line[k] in " \t":
            k += 1
        while k < len(line) and line[k] == ">":
            depth, k = depth + 1, k + 1
            if k < len(line) and line[k] in " \t":
                k += 1
        if not depth:
            own.append(line)
        elif depth == before:
            quotes[-1][1].append(line[k:])
        else:
            if not before and own and _says_who(own[-1]):
                own.pop()
            quotes.append((depth, [line[k:]]))
        before = depth
    if not quotes:
        return text, quotes
    while own and not own[0]:
        own = own[1:]
    while own and not own[-1]:
        own = own[:-1]
    return "\n".join(own), quotes


def _paragraphs(own):
    """Blocks of lines between lines that hold blanks only; the line after such a one begins a block even if it is blank too."""
    out, held, fresh = [], [], True
    for line in own.split("\n"):
        if not fresh and not line.strip(" \t"):
            out, held, fresh = [*out, "\n".join(held)], [], True
        else:
            held, fresh = [*held, line], False
    return [*out, "\n".join(held)]


def _says_who(line):
    line = line.rstrip(" \t")
    if not line.endswith(":") or ">" in line:
        return False
    line = line[:-1].removesuffix(" ").lower()
    for verb in ("wrote", "writes", "schrieb", "a écrit", "escribió"):
        who = line.removesuffix(verb)
        if who != line and who and not (who[-1].isalnum() or who[-1] == "_"):
            return True
    return False


def plain_key(text):
    return " ".join(text.lower().split())


def brute(rows):
    """For rows (conv, turn, role, text) with unique turns: (conv, position, turn, parent, root, depth, own text)."""
    out = []
    for conv in {r[0] for r in rows}:
        said, info = {}, {}
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            own, quotes = plain_parse(text or "")
            votes = {}
            for depth, lines in quotes:
                whole = plain_key("\n".join(lines))
                for key, w in [(plain_key(x), 1) for x in lines if x.strip()] + [(whole, len(lines) + 1)]:
                    if key in said:
                        votes[depth, said[key]] = votes.get((depth, said[key]), 0) + w
            parent = max(((-d, w, t) for (d, t), w in votes.items()), default=(0, 0, None))[2]
            root, depth = (turn, 0) if parent is None else (info[parent][0], info[parent][1] + 1)
            info[turn] = (root, depth, parent, own)
            for part in [own, *_paragraphs(own), *own.split("\n")]:
                if part.strip():
                    said.setdefault(plain_key(part), turn)
        order = sorted(info, key=lambda t: (info[t][0], t))
        out += [(conv, k, t, info[t][2], info[t][0], info[t][1], info[t][3]) for k, t in enumerate(order)]
    return sorted(out)


def _threads(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(rng.randrange(1, 14)):
            own = "\n".join(" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4)))
            if texts and rng.random() < 0.6:
                quoted = "\n".join("> " + x for x in rng.choice(texts).split("\n"))
                own = rng.choice(["", "Ann wrote:\n"]) + quoted.replace("w1", "W1") + "\n" + own
            texts.append(own)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), own))
    return rows


def test_links_and_order_match_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SLICE", 3)
    rows = _threads(4)
    got = chat_format.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    assert sorted((r.conv_id, r.position, r.turn, r.parent_turn, r.root_turn, r.depth, r.text) for r in got) == brute(rows)
    assert sum(r.n_linked > 0 for r in got) > 15 and not any(line.startswith(">") for r in got for line in r.text.split("\n"))


def test_nested_levels():
    own, quotes = chat_format.parse("Hi\nBob wrote:\n> > old\n> new\n>> old2\nanswer\n\n> x\nend")
    assert own == "Hi\nanswer\n\nend"
    assert quotes == [(2, ["old"]), (1, ["new"]), (2, ["old2"]), (1, ["x"])]


def test_edge_rows(spark):
    rows = [(None, None, None, None, 1), (1, 0, "user", "", 1), (1, 0, "user", "", 1), (1, 2, "user", "> nothing known\nx", 1), (1, 1, "a", ">" * 5000, 1), (2, 5, None, "y " * 100000, 1)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    got = sorted(((r.conv_id or -1, r.position, r.turn, r.n_quotes, r.n_linked, len(r.text)) for r in chat_format.conversations(docs).collect()), key=str)
    assert got == sorted([(-1, 0, None, 0, 0, 0), (1, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (1, 2, 1, 1, 0, 0), (1, 3, 2, 1, 0, 1), (2, 0, 5, 0, 0, 200000)], key=str)
    assert chat_format.conversations(docs.limit(0)).count() == 0


def test_query_over_the_small_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = queries.op7_chat_format(spark, SF).collect()
    assert sorted((r.conv_id, r.position, r.turn, r.root_turn) for r in got) == sorted((c, k, t, root) for c, k, t, _, root, *_ in brute([tuple(r) for r in rows]))


def test_parser_against_letter_by_letter_reading():
    rng = random.Random(2)
    pieces = ["> ", ">", ">>", " ", "\t", "\n", "\n", "\n\n", "a", "Bob wrote:", "Zoé a écrit :", "writes:", "overwrites:", "x > y", "On Monday Ann schrieb: "]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert chat_format.parse(t) == plain_parse(t), repr(t)


#: A thread in which every kind of quote stands: nested, attributed, by lines, in another order, of nobody.
THREAD = [
    (1, 0, "user", "Shall we meet?\n\nI can come on Monday.\nOr on Friday."),
    (1, 1, "assistant", "> I can come on Monday.\nMonday suits."),
    (1, 2, "user", "Ann wrote:\n>> I can come on Monday.\n> Monday suits.\n\nAt ten?"),
    (1, 3, "assistant", "> shall WE   meet?\nYes."),
    (1, 4, "user", "> nobody said this\nWho?"),
    (1, 5, "assistant", ">> Monday suits.\n> At ten?\nAt ten."),
]


def test_a_quoted_thread(spark):
    got = {r.turn: r for r in chat_format.conversations(spark.createDataFrame(THREAD, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: (r.parent_turn, r.root_turn, r.depth) for t, r in got.items()} == {0: (None, 0, 0), 1: (0, 0, 1), 2: (1, 0, 2), 3: (0, 0, 1), 4: (None, 4, 0), 5: (2, 0, 3)}
    assert [t for t, r in sorted(got.items(), key=lambda x: x[1].position)] == [0, 1, 2, 3, 5, 4]
    assert got[2].text == "At ten?" and got[2].n_quotes == 2 and got[2].n_linked == 2 and got[4].n_linked == 0
    assert got[5].formatted == "<|assistant|>\nAt ten.\n<|end|>\n"
    assert sorted((r.conv_id, r.position, r.turn, r.parent_turn, r.root_turn, r.depth, r.text) for r in got.values()) == brute(THREAD)
