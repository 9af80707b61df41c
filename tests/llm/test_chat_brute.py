"""Chat formatting against a plain reading of the same rules, on generated conversations with cycles, repeats, orphans and bad arguments."""

import json
import random
from collections import Counter, defaultdict

from tickloom.llm import chat_format

KINDS = {"string": str, "integer": int, "object": dict}


def dump(x):
    return json.dumps(x, separators=(",", ":"), sort_keys=True)


def once(pairs):
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("repeated key")
    return dict(pairs)


def parsed(text):
    try:
        return json.loads(text, object_pairs_hook=once)
    except (TypeError, ValueError):
        return ...


def fault(name, arguments):
    if name not in chat_format.SCHEMAS:
        return "unknown tool"
    wanted, given = chat_format.SCHEMAS[name], parsed(arguments)
    if not isinstance(given, dict):
        return "no object"
    said = [f"missing {a}" for a, (_, must) in wanted.items() if must and a not in given]
    said += [f"mistyped {a}" for a, (kind, _) in wanted.items() if a in given and (not isinstance(given[a], KINDS[kind]) or isinstance(given[a], bool))]
    return ", ".join(sorted(said + [f"unknown {a}" for a in given if a not in wanted])) or None


def levels(firsts):
    """By walking what each call waits for; None behind a cycle or a missing call."""
    known = {}

    def of(key, path):
        if key not in firsts or key in path:
            return None
        if key not in known:
            below = [of((key[0], d), path | {key}) for d in firsts[key][2]]
            known[key] = None if None in below else max(below, default=-1) + 1
        return known[key]

    return {key: of(key, frozenset()) for key in firsts}


def brute(rows):
    calls, results, out = [], [], []
    for conv, turn, role, text in rows:
        p = json.loads(text) if (text or "").lstrip().startswith("{") else {}
        told, answer = p.get("tool_calls") or [], p.get("tool_call_id")
        if not told and answer is None:
            out.append((conv, turn, 0, role, "message", None, None, None, turn, 0, 0, dump({"content": text, "role": role})))
        if told and answer is None and p.get("content") is not None:
            out.append((conv, turn, -1, role, "message", None, None, None, turn, 0, 0, dump({"content": p["content"], "role": role})))
        for i, c in enumerate(told):
            inner = c.get("function", {})
            arguments = c.get("arguments", inner.get("arguments"))
            arguments = arguments if arguments is None or isinstance(arguments, str) else json.dumps(arguments)
            calls.append((conv, turn, i, role, c.get("id"), c.get("name", inner.get("name")), arguments, c.get("depends_on") or []))
        if answer is not None:
            results.append((conv, turn, role, answer, p.get("content")))
    firsts = {}
    for conv, turn, i, _, name, _, _, waits in calls:
        if conv is not None and name is not None:
            firsts[conv, name] = min(firsts.get((conv, name), (turn, i, waits)), (turn, i, waits))
    level, answered = levels(firsts), {(r[0], r[3]) for r in results}
    for conv, turn, i, role, name, tool, arguments, _ in calls:
        key = (conv, name)
        status = "open" if key not in firsts else "repeated" if firsts[key][:2] != (turn, i) else "linked" if key in answered else "open"
        given = parsed(arguments)
        shown = dump(given) if given is not ... else arguments if arguments is not None else "null"
        out.append((conv, turn, i, role, "call", name, status, fault(tool, arguments), turn, level.get(key), 0, dump({"arguments": shown, "id": name, "name": tool, "role": role})))
    for conv, turn, role, name, content in results:
        first = firsts.get((conv, name))
        out.append((conv, turn, first[1] if first else 0, role, "result", name, "linked" if first else "orphan", None, first[0] if first else turn, level.get((conv, name)), 1, dump({"content": content, "id": name, "role": role})))
    return out


def conversations():
    rng = random.Random(11)
    arguments = [{"query": "x y"}, {"limit": 3, "query": "q"}, {"query": 5}, {"limit": "3"}, {"z": None, "query": "q"}, {"url": "u", "headers": {"b": 1, "a": [2, 1]}}, {"expression": "1+1"}, [1, 2], None, '{"query": oops', '{"query":"a","query":"b"}', '{ "query" : "spaced" }', ""]
    rows = []
    for conv in [*range(40), None]:
        names = [f"c{i}" for i in range(rng.randint(1, 7))]
        for turn in range(rng.randint(1, 10)):
            kind, text = rng.random(), None
            if kind < 0.2:
                text = rng.choice([None, "", "plain words", '{"other": 1}', "[1]", "two\nlines \"quoted\""])
            elif kind < 0.7:
                told = []
                for _ in range(rng.randint(1, 3)):
                    call, own = {}, {"name": rng.choice(["search", "calculate", "fetch", "none"])}
                    if rng.random() < 0.9:
                        call["id"] = rng.choice(names)
                    given = rng.choice(arguments)
                    if given is not None:
                        own["arguments"] = given
                    if rng.random() < 0.4:
                        own["arguments"] = own.get("arguments", "") if isinstance(own.get("arguments", ""), str) else json.dumps(own["arguments"])
                        call["function"] = own
                    else:
                        call |= own
                    if rng.random() < 0.5:
                        call["depends_on"] = [rng.choice([*names, "gone"]) for _ in range(rng.randint(0, 3))]
                    told.append(call)
                message = {"tool_calls": told}
                if rng.random() < 0.4:
                    message["content"] = "beside"
                if rng.random() < 0.2:
                    message["tool_call_id"] = rng.choice([*names, "orphan"])
                text = json.dumps(message)
            else:
                text = json.dumps({"tool_call_id": rng.choice([*names, "orphan"])} | ({"content": "found"} if rng.random() < 0.8 else {}))
            rows.append((conv, turn, rng.choice(["user", "assistant", "tool"]), text))
    long_chain = [(100, i, "assistant", json.dumps({"tool_calls": [{"id": f"k{i}", "name": "calculate", "arguments": {"expression": "1"}, "depends_on": [f"k{i - 1}"] if i else []}]})) for i in range(6)]
    return [*rows, *long_chain, rows[5], rows[5], rows[-1]]


def test_conversations_match_brute_force(spark):
    rows = conversations()
    clashing = [(*r, "x", "y", 1) for r in rows]
    df = spark.createDataFrame(clashing, "conv_id long, turn long, role string, text string, json string, call_id string, level int").repartition(5)
    got = Counter(map(tuple, chat_format.format_chats(df).select("conv_id", "turn", "position", "role", "kind", "call_id", "status", "fault", "anchor", "level", "part", "json").collect()))
    want = Counter(brute(rows))
    assert got == want, defaultdict(list, {"more": list((got - want).items())[:4], "less": list((want - got).items())[:4]})
    assert {k[6] for k in want} == {None, "linked", "open", "repeated", "orphan"} and max(k[9] or 0 for k in want) == 5
