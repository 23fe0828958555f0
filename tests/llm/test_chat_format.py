import random
import re
from collections import defaultdict

from quakeloom.llm.chat_format import format_chats, link_quotes, parse_quotes

MARK = re.compile(r"^[ \t]*(?:>[ \t]?)+")
ATTR = re.compile(r"^\s*(?:on|am|le|el)\b.*\b(?:wrote|schrieb|a écrit|escribió)\b.*:\s*$", re.I)


def brute(rows, block=64):
    """The same by plain loops over whole conversations."""
    normal = lambda x: re.sub(r"\s+", " ", x).strip(" ").lower()
    convs = defaultdict(set)
    for c, t, r, x in rows:
        convs[c].add((-1 if t is None else t, r or "unknown", x or ""))
    out = []
    for c, messages in convs.items():
        parsed = []
        for t, r, x in sorted(messages):
            lines = []
            for line in re.split("\r\n|\r|\n", x):
                m = MARK.match(line)
                lines.append((m[0].count(">") if m else 0, MARK.sub("", line)))
            lines = [(-1, b) if k == 0 and ATTR.match(b) and i + 1 < len(lines) and lines[i + 1][0] > 0 else (k, b) for i, (k, b) in enumerate(lines)]
            content = re.sub(r"^\s+|\s+$", "", re.sub(r"\n\s*\n(?:\s*\n)+", "\n\n", "\n".join(b for k, b in lines if k == 0)))
            passages = []
            for i, (k, b) in enumerate(lines):
                if i and lines[i - 1][0] == k:
                    passages[-1][1].append(b)
                else:
                    passages.append((k, [b]))
            parsed.append((t, r, content, [(k, b) for k, b in passages if k > 0]))
        origin = {}
        for t, _, content, _ in parsed:
            for x in {normal(content), *map(normal, content.split("\n"))} - {""}:
                origin[x] = min(t, origin.get(x, t))
        votes = defaultdict(lambda: defaultdict(int))
        for t, _, _, quoted in parsed:
            for k, b in quoted:
                for x in {normal("\n".join(b)), *map(normal, b)} - {""}:
                    if origin.get(x, t) < t:
                        votes[t, k][origin[x]] += len(x)
        linked = {tk: max(v, key=lambda o: (v[o], o)) for tk, v in votes.items()}
        reply = {t: None for t, *_ in parsed}
        for t in reply:
            if levels := sorted(k for u, k in linked if u == t):
                of = linked[t, levels[0]]
                between = [u for (u, k), o in linked.items() if k == levels[0] - 1 and o == of and u < t]
                reply[t] = max(between, default=of)
        thread, threads = None, defaultdict(list)
        for t in sorted(reply):
            if t - 1 not in reply or reply[t] not in (None, t - 1):
                thread = t
            threads[thread, (t - thread) // block] += [m for m in parsed if m[0] == t]
        for (start, b), ms in threads.items():
            ms.sort(key=lambda m: m[:3])
            turns = [m[0] for m in ms]
            cut = block if max(turns.count(t) for t in turns) > block else len(ms)
            for piece, lo in enumerate(range(0, len(ms), cut)):
                part = ms[lo : lo + cut]
                text = "\n".join(f"<|{r}|>\n{x}" for _, r, x, _ in part)
                out.append((c, start, b, piece, reply[start] if part[0][0] == start else None, len(part), sum(len(q) for *_, q in part), text))
    return out


KEY = lambda x: tuple((v is None, "" if v is None else v) for v in x)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=KEY)


def test_small_thread(spark):
    rows = [
        (1, 0, "user", "How are you?\nSecond line here."), (1, 1, "assistant", "> how  are you?\nFine."),
        (1, 2, "user", "On Monday, A wrote:\n> Fine.\n> > How are you?\nGood to know."), (1, 3, "assistant", ">second LINE here.\nBack to that."), (1, 4, "user", "Thanks."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(format_chats(df)) == sorted(brute(rows), key=KEY)
    got = {r.thread_turn: r for r in format_chats(df).collect()}
    assert got[3].reply_to == 0 and got[3].text == "<|assistant|>\nBack to that.\n<|user|>\nThanks."
    assert got[0].n_messages == 3 and "wrote" not in got[0].text and ">" not in got[0].text.replace("|>", "")
    assert sorted((r.turn, r.level, r.origin) for r in link_quotes(parse_quotes(df)).collect()) == [(1, 1, 0), (2, 1, 1), (2, 2, 0), (3, 1, 0)]


def test_against_brute_force(spark):
    r = random.Random(3)
    pool = [" ".join(r.choice("one two three four Five six".split()) for _ in range(r.randint(1, 5))) for _ in range(40)]
    rows = [(None, None, None, None), (7, None, "user", ""), (7, 3, None, "> nothing known\n\n\n\nx")]
    for c in range(12):
        said = []
        for t in range(r.choice([3, 9, 150])):
            own = [r.choice(pool) for _ in range(r.randint(1, 3))]
            quote = []
            if said and r.random() < 0.5:
                quote = ["On day X wrote:"] * (r.random() < 0.5) + [("> " if r.random() < 0.7 else "> > ") + x for x in r.choice(said)]
            said.append(own)
            if r.random() < 0.95:
                rows.append((c, t, r.choice(["user", "assistant"]), "\n".join(quote + own if r.random() < 0.5 else own + quote)))
    rows += rows[5:20] + [(3, 1, "user", "another of one turn")]
    df = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, content string")
    assert rows_of(format_chats(df, block=16)) == sorted(brute(rows, 16), key=KEY)
    assert format_chats(df.filter("false")).count() == 0


def test_crowded_turn_is_spread_over_rows(spark):
    rows = [(1, None, "user", f"message {i}") for i in range(200)] + [(1, 0, "user", "next"), (1, 1, "user", "last")]
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=8).collect()
    crowded = sorted((x.piece, x.n_messages) for x in got)
    assert crowded == [(k, 8) for k in range(25)] + [(25, 2)] and {(x.conv_id, x.thread_turn, x.block) for x in got} == {(1, -1, 0)}
    said = [x.strip() for g in sorted(got, key=lambda g: g.piece) for x in g.text.split("<|user|>\n") if x]
    assert said == [*sorted(x[3] for x in rows[:200]), "next", "last"]
    got = format_chats(spark.createDataFrame(rows * 2, "conv_id long, turn long, role string, text string"), block=8)
    assert rows_of(got) == sorted(brute(rows, 8), key=KEY)


def test_deeper_levels_decide_where_the_first_was_edited(spark):
    rows = [
        (1, 0, "a", "The first words of all."), (1, 1, "b", "> The first words of all.\nAn answer."), (1, 2, "c", "Something else."),
        (1, 3, "a", "> An answer, edited.\n> > The first words of all.\nTo the answer."), (1, 4, "b", "> Not said.\n> > Nor this.\n> > > The first words of all.\nFar."),
        (2, 0, "a", "Alone."), (2, 1, "b", "x"), (2, 2, "c", "> edited\n> > Alone.\nNobody quoted it."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.thread_turn): r.reply_to for r in format_chats(df).collect()}
    assert got == {(1, 0): None, (1, 3): 1, (2, 0): None, (2, 2): 0}
    assert rows_of(format_chats(df)) == sorted(brute(rows), key=KEY)


def test_very_long_messages(spark):
    long = "word " * 200_000
    rows = [(1, 0, "a", long + "\nline"), (1, 1, "b", "x"), (1, 2, "c", f"> {long}\n> line\nanswer")]
    got = {r.thread_turn: r for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[2].reply_to == 0 and got[2].text == "<|c|>\nanswer" and len(got[0].text) > len(long)
