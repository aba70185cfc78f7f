import random

from tidewatch.llm import quotations as Q


def test_parse():
    text = "Hello.\n\nOn Monday, Ann wrote:\n> One two.\n> Three\n>> deep one\n> > deep two\n> back\nMy answer.\n  > last\n"
    own, passages = Q.parse_quotes(text)
    assert own == "Hello.\n\nMy answer."
    assert passages == [(1, ["One two.", "Three"]), (2, ["deep one", "deep two"]), (1, ["back"]), (1, ["last"])]
    for same in ("", "no quote\n\n", "a > b", "     > code"):
        assert Q.parse_quotes(same) == (same, [])


def test_normalised_sentences_survive_wrapping():
    assert Q._units(["One  two three. Four", "five six!"]) == Q._units(["one two", "THREE.  four five", "six!"])
    assert Q._units(["...", ""]) == []


def plain(rows):
    """The rules, message by message."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        parsed = [Q.parse_quotes(r[3] or "") for r in own]
        parent, linked, quoted = [], [], []
        for k, (_, passages) in enumerate(parsed):
            wanted = {(n, h) for n, lines in passages for h in Q._units(lines)}
            count = {}
            for n, h in wanted:
                source = next((j for j in range(len(own)) if h in Q._units(parsed[j][0].split("\n"))), None)
                if source is not None and source < k:
                    count[n, source] = count.get((n, source), 0) + 1
            best = min(count, key=lambda c: (c[0], -count[c], c[1]), default=None)
            parent.append(best[1] if best else k - 1)
            linked.append(sum(count.values()))
            quoted.append(len(wanted))
        order = []

        def walk(k):
            order.append(k)
            for j in range(len(own)):
                if parent[j] == k:  # noqa: B023
                    walk(j)

        walk(0)
        out[conv] = [(own[k][1], own[k][2], own[parent[k]][1] if k else None, quoted[k], linked[k],
                      parsed[k][0] if own[k][3] is not None else None) for k in order]
    return out


def test_against_plain_rules(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randrange(1, 30)):
            own = " ".join(f"{rng.choice('abcdefg')}{rng.randrange(30)} word." for _ in range(rng.randrange(1, 5)))
            text = own
            if said and rng.random() < 0.6 and conv % 4:
                source = rng.choice(said)
                lines = source.split("\n")
                text = "X wrote:\n" + "\n".join("> " + x for x in lines) + "\n" + own + "\n> never said."
            said.append(text)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
    rows += [(50, 0, "user", None), (50, None, None, ""), (50, 1, "user", "same"), (50, 1, "user", "same"), (None, 1, "user", "hi there."), (None, 2, "x", "> hi there.\nyes")]
    data = spark.createDataFrame([(*r, 7, "p") for r in rows], "conv_id long, turn long, role string, text string, seq int, parent string")
    got = {}
    for r in sorted(Q.link_conversations(data).collect(), key=lambda r: r["position"]):
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["reply_to"], r["n_quoted"], r["n_linked"], r["text"]))
        assert r["formatted"] == f"<|im_start|>{r['role'] or ''}\n{r['text'] or ''}<|im_end|>\n"
    want = plain(rows)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for k in want:
        assert got[k] == want[k], k
    assert Q.link_conversations(data.limit(0)).count() == 0
