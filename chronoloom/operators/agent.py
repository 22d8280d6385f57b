"""The question loop: a model chooses searches over memories until it answers, a gate abstains on ambiguity.

Control stays on the driver and is bounded by rounds and errors; each search is one Spark query whose k
rows come back.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from chronoloom.functions import jsonfix

#: (query, until, ids seen so far) to a table with the columns id and text, best first and few
Search = Callable[[str, str, set], DataFrame]


@dataclass
class Outcome:
    answer: str | None
    rounds: list[dict] = field(default_factory=list)
    abstained: bool = False
    errors: int = 0


def ask(
    question: str,
    until: str,
    memories: dict[str, Search],
    reason: Callable[[str], str],
    respond: Callable[[str], str],
    gate: Callable[[str, str], tuple[float, int]] | None = None,
    rounds: int = 5,
    errors: int = 5,
    theta: float = 0.75,
) -> Outcome:
    """gate gives (confidence, candidates) for the question as of until; under theta with two or more it abstains.

    reason sees question and history and replies {"decision": "search" or "answer", "selected_memory":
    {"memory_type", "search_query"}}; what does not parse is an answer.  A memory it does not know, or a
    search that fails, counts as an error and goes into the history.
    """
    out = Outcome(None)
    if gate is not None:
        sure, n = gate(question, until)
        if n >= 2 and sure < theta:
            out.abstained = True
            return out
    seen: dict[str, set] = {m: set() for m in memories}
    while len(out.rounds) < rounds and out.errors < errors:
        reply, how = jsonfix.salvage(reason(json.dumps({"question": question, "until": until, "memories": sorted(memories), "history": out.rounds}, ensure_ascii=False)))
        pick = reply.get("selected_memory") if isinstance(reply, dict) and reply.get("decision") == "search" else None
        if not isinstance(pick, dict):
            break
        name, query = pick.get("memory_type"), str(pick.get("search_query", ""))
        try:
            rows = memories[name](query, until, seen[name]).select("id", "text").collect()  # the search's own k
        except Exception as e:  # the model may name anything, and a search may fail in any way
            out.errors += 1
            out.rounds.append({"memory": name, "query": query, "error": type(e).__name__})
            continue
        seen[name] |= {r["id"] for r in rows}
        out.rounds.append({"memory": name, "query": query, "found": [r["text"] for r in rows]})
    out.answer = respond(json.dumps({"question": question, "until": until, "history": out.rounds}, ensure_ascii=False))
    return out
