"""Task notes: board views and the property contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegauge.functions import text as X
from notegauge.functions.lexer import lexed
from notegauge.operators.validate import blank, violations

# The property vocabularies, the views with their columns, and display names.
STATUSES = ("triage", "todo", "in-progress", "waiting-for", "blocked", "done", "cancelled")
ENUMS = {
    "status": STATUSES,
    "priority": ("P0", "P1", "P2", "P3", "unknown"),
    "execution_shape": ("human", "agent", "agent-first", "unknown"),
    "task_type": ("create", "investigate", "decide", "communicate", "meet", "administer", "maintain", "practice", "consume", "other", "unknown"),
    "human_energy": ("none", "low", "medium", "high", "unknown"),
    "source_type": ("user-request", "meeting", "message", "document", "code", "observation", "agent-recommendation", "import", "unknown"),
}
VIEWS = {
    "Triage": (("triage",), ("name", "priority", "execution_shape", "task_type", "human_energy", "goal")),
    "Todo": (("todo",), ("name", "priority", "due", "not_before", "execution_shape", "human_energy", "project", "people", "goal")),
    "In progress": (("in-progress",), ("name", "priority", "due", "execution_shape", "human_energy", "project", "people", "goal")),
    "Waiting for": (("waiting-for",), ("name", "waiting_on", "follow_up_on", "priority", "project", "people", "goal")),
    "Blocked": (("blocked",), ("name", "blocked_on", "blocked_since", "priority", "project", "people", "goal")),
    "History": (("done", "cancelled"), ("name", "status", "date_closed", "project", "people", "goal")),
    "All tasks": (None, ("name", "status", "priority", "execution_shape", "task_type", "human_energy", "due", "project", "people", "goal")),
}
DISPLAY = {
    "name": "Task", "goal": "Goal", "execution_shape": "Execution shape", "human_energy": "Human energy", "source_type": "Source type", "task_type": "Task type",
    "waiting_on": "Waiting on", "follow_up_on": "Follow up on", "blocked_on": "Blocked on", "blocked_since": "Blocked since", "date_closed": "Closed",
}
CONDITIONAL = {"waiting-for": ("waiting_on", "follow_up_on"), "blocked": ("blocked_on", "blocked_since"), "done": ("date_closed",), "cancelled": ("date_closed",)}


def tasks(notes: DataFrame) -> DataFrame:
    """Notes of the task folder."""
    return notes.filter(F.col("path").startswith("Tasks/") & F.col("path").endswith(".md"))


def view(notes: DataFrame, name: str, display: bool = False) -> DataFrame:
    statuses, columns = VIEWS[name]
    df = tasks(notes).withColumn("name", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", ""))
    df = (df.filter(F.col("status").isin(*statuses)) if statuses else df).select(*columns)
    return df.withColumnsRenamed({c: DISPLAY[c] for c in columns if c in DISPLAY}) if display else df


def contract_violations() -> Column:
    """What a task breaks: vocabularies, readiness, and the properties that its status asks for or forbids."""
    c = F.col
    needed = lambda s, k: c("status").isin(*[x for x, ks in CONDITIONAL.items() if k in ks])
    stale = sorted({k for ks in CONDITIONAL.values() for k in ks})
    unknown = F.lit(False)
    for k in ENUMS:
        if k != "status":
            unknown = unknown | (c(k) == "unknown")
    return violations(
        *[(~F.coalesce(c(k).isin(*v), F.lit(False)), f"{k} is not in the vocabulary") for k, v in ENUMS.items()],
        (blank(c("goal")), "goal is required"),
        (unknown & (c("status") != "triage"), "a task with an unknown property stays in triage"),
        *[((c("status") == s) & c(k).isNull(), f"{s} requires {k}") for s, ks in CONDITIONAL.items() for k in ks],
        *[(c(k).isNotNull() & ~needed(None, k), f"{k} is stale for this status") for k in stale],
    )


# The sections of a task note in order, those that a status asks for, and the form of a work-log entry.
BODY_SECTIONS = ("Context", "Definition of done", "Inputs", "Constraints", "Source", "Deliverables", "Result", "Work log")
STATUS_SECTIONS = {"blocked": "Unblock condition", "cancelled": "Cancellation reason"}
LOG_ENTRY = r"^- \d{4}-\d{2}-\d{2} \d{2}:\d{2} \u2014 [^:]+: \S"


def body_sections(content: Column) -> Column:
    """Array of (name, text) of the level-2 headings of a note's structure, each down to the next of its level or above."""
    rows = F.split(X.body(X.normalized(content)), "\n")
    tops = F.filter(lexed(content, "headings")["headings"], lambda h: h["level"] <= 2)

    def cut(of: Column) -> Column:
        rows, tops = of["rows"], of["tops"]
        stop = lambda i: F.coalesce(F.get(tops, i + 1)["line"], F.size(rows))
        every = F.transform(tops, lambda h, i: F.struct(h["level"].alias("level"), h["text"].alias("name"), F.array_join(F.slice(rows, h["line"] + 2, stop(i) - h["line"] - 1), "\n").alias("text")))
        return F.filter(every, lambda s: s["level"] == 2)

    return X.let(F.struct(rows.alias("rows"), tops.alias("tops")), cut)


def body_violations(sections: Column, status: Column) -> Column:
    """What the body of a task (its body_sections()) breaks: sections and their order, what the status asks for, the checklist and the work log."""
    every = dict.fromkeys((*BODY_SECTIONS, *STATUS_SECTIONS.values()))
    text = lambda name: F.coalesce(F.get(F.filter(sections, lambda s: s["name"] == name), F.lit(0))["text"], F.lit(""))
    names = F.transform(sections, lambda s: s["name"])
    return X.let(F.struct(names.alias("names"), *[text(n).alias(n) for n in every]), lambda told: _body_violations(told["names"], lambda n: told[n], status))


def _body_violations(names: Column, text: Callable[[str], Column], status: Column) -> Column:
    """body_violations() of the names of the sections and the text of each that is spoken of, empty without it."""
    required = F.array(*map(F.lit, BODY_SECTIONS))
    empty = lambda name: X.strip(text(name)) == ""
    present = lambda name: F.array_contains(names, name)
    lacking = F.array_except(required, names)
    in_order = F.filter(names, lambda n: F.array_contains(required, n)) == required
    entries = F.filter(F.split(text("Work log"), "\n"), lambda x: X.strip(x) != "")
    beside_log = lambda name: F.array_position(names, name) + 1 == F.array_position(names, "Work log")
    boxes = lambda mark: F.exists(F.split(text("Definition of done"), "\n"), lambda x: x.rlike(rf"^\s*[-*+] \[{mark}\]"))
    return violations(
        (F.size(lacking) > 0, F.concat(F.lit("missing sections: "), F.array_join(lacking, ", "))),
        ((F.size(lacking) == 0) & ~in_order, "sections are out of order"),
        *[(present(n) & empty(n), f"{n} is empty") for n in BODY_SECTIONS[:5]],
        *[((status == s) & empty(n), f"{s} requires {n}") for s, n in STATUS_SECTIONS.items()],
        *[((status == s) & present(n) & ~beside_log(n), f"{n} belongs right before Work log") for s, n in STATUS_SECTIONS.items()],
        *[((status != s) & present(n), f"{n} is stale for this status") for s, n in STATUS_SECTIONS.items()],
        (present("Definition of done") & ~boxes("[ xX]"), "Definition of done has no checklist"),
        ((status == "done") & boxes(" "), "done with an unchecked item"),
        ((status == "done") & empty("Result") & empty("Deliverables"), "done requires Result or Deliverables"),
        (F.exists(entries, lambda x: ~x.rlike(LOG_ENTRY)), "work log entry is malformed"),
    )


def transitions(events: DataFrame) -> DataFrame:
    """(task, ts, before, status, shape, legal): changes of status of events (task, ts, status, execution_shape, actor, and waiting_on where it is known).

    A user may do anything. An agent may not cancel, nor close a task that a person has
    to accept or finish; it hands a task that is agent-first back to whom it waits for.
    """
    order = Window.partitionBy("task").orderBy("ts")
    moved = events.withColumn("before", F.lag("status").over(order)).filter("before is not null and before <> status")
    by_agent = F.col("actor") == "agent"
    closing = (F.col("status") == "done") & F.col("execution_shape").isin("agent-first", "human", "unknown")
    handing = (F.col("status") == "waiting-for") & (F.col("execution_shape") == "agent-first") & (blank(F.col("waiting_on")) if "waiting_on" in events.columns else F.lit(False))
    illegal = by_agent & (closing | handing | (F.col("status") == "cancelled"))
    return moved.select("task", "ts", "before", "status", "execution_shape", (F.col("status").isin(*STATUSES) & ~illegal).alias("legal"))


#: Properties by which the tasks that a new one may repeat are looked for.
FACETS = ("goal", "title", "project", "people", "source")


def closest(tasks_: DataFrame, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """(path, other, shared): for each task the first task by path with an equal facet, and the facets that lead there.

    Facets are compared without case and outer white space; blank ones say nothing. A
    value that many tasks share names one of them, not all pairs; which are the same
    outcome is a person's decision.
    """
    value = lambda c: F.lower(X.strip(F.col(c).cast("string")))
    told = tasks_.select("path", F.explode(F.filter(F.array(*[F.struct(F.lit(c).alias("facet"), value(c).alias("value")) for c in facets]), lambda f: f["value"] != "")).alias("f")).select("path", "f.*")
    first = told.groupBy("facet", "value").agg(F.min("path").alias("other"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = told.join(first, ["facet", "value"]).filter("path <> other")
    return shared.groupBy("path", "other").agg(F.array_sort(F.collect_set("facet")).alias("shared"))


#: Of the words of two tasks' goals and titles, the share that closest matches have in common at least, and how many are shown.
NEAR, SHOWN = 0.5, 3
#: Facets of equal value, which order matches that are equally near by words.
SAME = ("project", "people", "source")


def word_set(*columns: str) -> Column:
    """The distinct words of text columns in lower case, sorted; letters and digits make words."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return F.array_sort(F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")))


def near_sets(sets: DataFrame, near: float = NEAR) -> DataFrame:
    """(a, b, shared, similarity) of the pairs a < b of ``sets`` (id, words; distinct sets without blanks) whose words overlap by ``near`` or more (Jaccard).

    A join on words by prefixes. Words are numbered by rarity. Two sets that overlap by
    ``near`` share one of the rarest words of each: of the larger the first n - ceil(near
    * n) + 1, of the smaller the first n - ceil(2 * near / (1 + near) * n) + 1. Common
    words thus seldom take part, and pairs whose places or sizes leave too little to
    share are dropped in the join, before their words are compared.
    """
    word = sets.select("id", F.posexplode("words").alias("__p", "word")).drop("__p")
    rarity = word.groupBy("word").agg(F.count("*").alias("held"))
    ordered = word.join(rarity, "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("held", "word"))).alias("w")).select("id", F.transform("w", lambda x: x["word"]).alias("words"), F.size("w").alias("n"))
    cut = lambda share: (F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1).cast("int")
    side = lambda share, s: ordered.select(F.col("id").alias(f"id_{s}"), F.col("words").alias(f"words_{s}"), F.col("n").alias(f"n_{s}"), F.posexplode(F.slice("words", F.lit(1), cut(share))).alias(f"p_{s}", "word"))
    large, small = side(near, "l"), side(2 * near / (1 + near), "s")
    order = (F.col("n_s") < F.col("n_l")) | ((F.col("n_s") == F.col("n_l")) & (F.col("id_s") < F.col("id_l")))
    needed = F.ceil(F.lit(near / (1 + near)) * (F.col("n_l") + F.col("n_s")) - 1e-9)
    reachable = F.least(F.col("n_l") - F.col("p_l"), F.col("n_s") - F.col("p_s"))  # from these places on
    met = large.join(small, "word").filter(order & (F.col("n_s") >= F.lit(near) * F.col("n_l") - 1e-9) & (reachable >= needed))
    shared = F.size(F.array_intersect("words_l", "words_s"))
    pairs = met.select("id_l", "id_s", shared.alias("shared"), (F.col("n_l") + F.col("n_s")).alias("both")).distinct()
    similarity = F.col("shared") / (F.col("both") - F.col("shared"))
    return pairs.select(F.least("id_l", "id_s").alias("a"), F.greatest("id_l", "id_s").alias("b"), "shared", similarity.alias("similarity")).filter(F.col("similarity") >= near)


def closest_by_words(tasks_: DataFrame, near: float = NEAR, shown: int = SHOWN) -> DataFrame:
    """(path, other, similarity, same, rank): for each task the nearest others by the words of goal and title, at most ``shown``.

    Nearest first; of equally near ones that with more equal facets (project, people,
    source; blank ones say nothing), then by path. Tasks without words have none. Paths
    are unique.

    Tasks with one set of words are one set in the search. For each choice of facets and
    their values a set offers its first tasks by path: the nearest of a task are among
    the offers for what it has equal with them, so a goal or a project that all tasks
    share makes no pairs of all with all.
    """
    value = lambda c: F.lower(X.strip(F.coalesce(F.col(c).cast("string"), F.lit("")))) if c in tasks_.columns else F.lit("")
    told = tasks_.select("path", word_set("goal", "title").alias("words"), F.array(*[value(c) for c in SAME]).alias("facets")).filter("size(words) > 0").withColumn("id", F.concat_ws(" ", "words"))
    sets = told.select("id", "words").distinct()
    pairs = near_sets(sets, near)
    both = pairs.select("a", "b", "similarity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(sets.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))
    chosen = [[i for i in range(len(SAME)) if mask >> i & 1] for mask in range(1 << len(SAME))]

    def choices(facets: Column) -> Column:
        """The values of each choice of facets, all others null; those with a blank among them say nothing."""
        every = F.array(*[F.array(*[facets[i] if i in own else F.lit(None).cast("string") for i in range(len(SAME))]) for own in chosen])
        return F.filter(every, lambda c: ~F.coalesce(F.array_contains(c, ""), F.lit(False)))

    key = F.to_json(F.col("choice"))
    by_path = Window.partitionBy("b", "choice").orderBy("other")
    offered = told.select(F.col("id").alias("b"), F.col("path").alias("other"), F.col("facets").alias("theirs"), F.explode(choices(F.col("facets"))).alias("choice")).withColumn("choice", key)
    offered = offered.withColumn("__n", F.row_number().over(by_path)).filter(F.col("__n") <= shown + 1).drop("__n")  # one may be the task itself
    kinds = told.select(F.col("id").alias("a"), "facets").distinct()  # tasks with one set and the same facets see the same offers
    asked = kinds.join(both, "a").select("*", F.explode(choices(F.col("facets"))).alias("choice")).withColumn("choice", key)
    same = F.size(F.filter(F.zip_with("facets", "theirs", lambda x, y: (x == y) & (x != "")), lambda t: t))
    seen = asked.join(offered, ["b", "choice"]).select("a", "facets", "other", "similarity", same.alias("same")).distinct()
    order = lambda *key: Window.partitionBy(*key).orderBy(F.col("similarity").desc(), F.col("same").desc(), "other")
    seen = seen.withColumn("__n", F.row_number().over(order("a", "facets"))).filter(F.col("__n") <= shown + 1).drop("__n")
    own = told.select("path", F.col("id").alias("a"), "facets").join(seen, ["a", "facets"]).filter("path <> other")
    ranked = own.withColumn("rank", F.row_number().over(order("path"))).filter(F.col("rank") <= shown)
    return ranked.select("path", "other", "similarity", "same", "rank")


def entries_of(sections: Column, name: str = "Work log") -> Column:
    """The entries of a list section (of body_sections()): a line that begins one, with the lines that follow it."""
    text = F.coalesce(F.get(F.filter(sections, lambda s: s["name"] == name), F.lit(0))["text"], F.lit(""))
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=[-*+] )")
    return F.filter(F.transform(parts, X.strip), lambda e: e != "")


def history_rewrites(versions: DataFrame, name: str = "Work log") -> DataFrame:
    """(path, ts, kept, was, now, first_lost, kind) of the versions (path, ts, content) of task notes whose history does not go on from the version before.

    The entries of a section may only grow at the end: those of a version begin with all
    those of the one before it. ``kept`` is how many do, of ``was`` before and ``now``
    after; ``first_lost`` is the first entry that is not in its place. ``kind`` is removed
    (some are gone, none is new), rewritten (some are gone, others new), reordered (all
    are there in another order) or inserted (all are there in order, with others before
    some of them). Versions follow one another by ts, of one ts by the hash of their content.
    """
    order = Window.partitionBy("path").orderBy("ts", "content_hash")
    told = versions.select("path", "ts", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"), entries_of(body_sections(F.coalesce("content", F.lit(""))), name).alias("entries"))
    pairs = told.withColumn("before", F.lag("entries").over(order)).filter("before is not null")
    df = pairs.filter(F.slice("entries", F.lit(1), F.size("before")) != F.col("before"))  # most go on, which one comparison tells
    kept = F.array_position(F.zip_with("before", "entries", lambda x, y: x.eqNullSafe(y)), False) - 1
    df = df.withColumn("kept", kept.cast("int"))

    def judged(of: Column) -> Column:
        tail, rest = of["tail"], of["rest"]
        fewer = F.size(rest) < F.size(tail)  # one of several equal entries may be gone
        gone, new = (F.size(F.array_except(tail, rest)) > 0) | fewer, F.size(F.array_except(rest, tail)) > 0
        in_order = F.filter(rest, lambda e: F.array_contains(tail, e)) == tail
        return X.let(gone, lambda gone: F.when(gone & ~new, "removed").when(gone, "rewritten").when(in_order, "inserted").otherwise("reordered"))

    tail, rest = F.slice("before", F.col("kept") + 1, F.size("before")), F.slice("entries", F.col("kept") + 1, F.size("entries"))
    kind = X.let(F.struct(tail.alias("tail"), rest.alias("rest")), judged)
    return df.select("path", "ts", "kept", F.size("before").alias("was"), F.size("entries").alias("now"), F.get("before", F.col("kept")).alias("first_lost"), kind.alias("kind"))
