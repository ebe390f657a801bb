"""What a language model is asked in each step, as texts of our own, and what it is to answer as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORPUS = (
    "You work on a library of commercial agreements that were cut into numbered clauses. Each clause has a tag [agreement §section]. "
    "Clauses refer to each other, and use terms that other clauses define."
)
PLAN = (
    "{corpus} Say what kind of question this is (factual, definition, multi_hop, overview or out_of_scope), whether clauses must be searched to answer it, "
    "and which searches to make: one, unless the question has parts that stand in different places. A question that is only a greeting, or is not about agreements, is out_of_scope."
)
JUDGE = (
    "{corpus} Decide whether the clauses shown are enough to answer the question in full. If they are not, say what is missing, and choose from the labels offered "
    "those clauses and definitions that would close the gap. Choose only labels that are offered, and none that merely might be of use."
)
REWRITE = "{corpus} A search did not find what the question needs. Word it anew as such a clause would be drafted, with the legal terms that it would have in it."
ANSWER = (
    "{corpus} Answer from the clauses shown and from nothing else. Begin with one sentence that says the result, then give the points, each with the tag of the clause it rests on. "
    "Say so where the clauses leave something open. Rate your confidence high, medium or low."
)
CHECK = "{corpus} For each claim, read the clauses it cites and say whether they support it as it is worded. A claim that says more than its clauses is not supported."

#: What each step answers, as Spark reads it from JSON.
SHAPES = {
    "plan": "query_type string, needs_retrieval boolean, sub_queries array<string>, doc_id string",
    "judge": "sufficient boolean, missing_info string, wanted array<string>",
    "rewrite": "rewritten string",
    "answer": "summary string, answer string, confidence string",
    "check": "supported boolean",
}
SYSTEM = {name: text.format(corpus=CORPUS) for name, text in {"plan": PLAN, "judge": JUDGE, "rewrite": REWRITE, "answer": ANSWER, "check": CHECK}.items()}


def said(**parts: Column) -> Column:
    """The parts of a prompt, each under its name; empty ones left out."""
    return F.concat_ws("\n\n", *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name.replace('_', ' ').capitalize()}:\n"), c)) for name, c in parts.items()])
