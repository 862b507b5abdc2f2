"""Long lists are put into rows that name them, after all that gathers or sorts these rows."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import MIN
from tests.test_summary import DAY, WORK
from threadloom.operators import late, names
from threadloom.plans import report, summary

OWNERS = [f"U{i}" for i in range(1, 7)]


@pytest.fixture(scope="module")
def crowd(spark, chat):
    """Six owners of threads in two channels, one of them a group; U2 is twice in the directory, and a name has a line break."""
    def make(model=None):
        rows = []
        for channel, start in (("C1", 100), ("G1", 300), ("G1", 700)):
            rows += [(DAY + start, "U1", f"Question #{start} {WORK}", {"channel": channel})]
            rows += [(DAY + start + i, u, f"Answer {WORK} {WORK}", {"channel": channel, "thread": DAY + start}) for i, u in enumerate(OWNERS)]
        rows += [(DAY + 800, "U1", f"Something else {WORK} {WORK}", {"channel": "G1"}), (DAY + 790, "U7", "before that", {"channel": "G1"}),
                 (DAY + 120, "U2", f"More on #100 {WORK} {WORK}"), (DAY + 118, "U8", f"in between {WORK} {WORK}")]
        span = spark.createDataFrame([(u, "p", DAY * MIN, 2 * DAY * MIN - 1000, "UTC") for u in OWNERS] + [("U9", "q", 0, MIN, "UTC")],
                                     "owner_id string, period_no string, start_us long, end_us long, tz string")
        chans = spark.createDataFrame([("C1", "general", False, False, False, False, None), ("G1", "mpdm-a--b-1", False, True, False, False, None)],
                                      "id string, name string, is_im boolean, is_mpim boolean, is_private boolean, is_group boolean, user string")
        known = spark.createDataFrame([("U1", "Ann Lee"), ("U2", "Bo"), ("U2", "Bob"), ("U3", "Cy\nde")], "user_id string, shown_name string")
        members = spark.createDataFrame([("G1", i, u) for i, u in enumerate(reversed(OWNERS))], "channel string, place int, user_id string")
        return summary.UserSummaries(chat(rows), span, known, chans, members, "https://acme.slack.com", model)

    return make


@pytest.mark.parametrize(("part_chars", "batch_chars"), [(1 << 30, 1 << 24), (8, 1), (20, 7)])
def test_rows_get_the_lists_they_name(spark, part_chars, batch_chars):
    texts = {("a", "x"): ["one", "two"], ("a", "y"): [], ("a", "z"): ["three"], ("b", "x"): ["four", None, "five"], ("c", "x"): ["unused"]}
    lists = spark.createDataFrame([(g, r, sum(len(t or "") for t in items), items) for (g, r), items in texts.items()], "g string, ref string, size long, items array<string>")
    asked = [(n, "ab"[n % 2], [["x"], ["z", "x", "x"], [], ["y"]][n % 4] if n % 2 == 0 else [["x"], []][n // 2 % 2], {"k": n}) for n in range(40)] + [(99, "d", [], {"k": 9})]
    rows = spark.createDataFrame(asked, "id long, g string, refs array<string>, more struct<k:long>")
    got = late.with_lists(rows, lists, ["g"], part_chars, batch_chars).collect()
    assert sorted((r.id, r.g, r.more.k, r.lists) for r in got) == [(n, g, more["k"], [texts[g, r] for r in refs]) for n, g, refs, more in asked]


def test_names_of_group_channels_are_cut_from_one_text(spark):
    people = spark.createDataFrame([(f"U{i}", f"N{i} x") for i in range(1, 40)] + [("U7", "Other name"), ("U8", None), ("U9", " odd")], "user_id string, shown_name string")
    chans = spark.createDataFrame([("G1", "mpdm-n1--zed-1", False, True, None), ("G2", "mpdm-n1--zed-1", False, True, None)], "id string, name string, is_im boolean, is_mpim boolean, user string")
    members = spark.createDataFrame([("G1", 50 - i, f"U{i}") for i in range(1, 40)] + [("G1", 99, "U5"), ("G2", 0, "U3")], "channel string, place int, user_id string")
    asked = spark.createDataFrame([(o, c) for c in ("G1", "G2") for o in ("U1", "U39", "U5", "U7", "U3", "U77")], "owner_id string, channel string")
    parts, texts = names.channel_name_parts(asked, chans, members, people)
    assert texts.count() == 2 and max(len(str(r)) for r in parts.collect()) < 300, "no row holds the names of all"
    got = {(r.owner_id, r.channel): r.channel_name for r in names.channel_names(asked, chans, members, people).collect()}
    known = {}
    for r in people.collect():
        known.setdefault(r.user_id, []).append(r.shown_name)
    folk = {"G1": [(50 - i, f"U{i}") for i in range(1, 40)] + [(99, "U5")], "G2": [(0, "U3")]}

    def listed(owner, channel):
        entries = sorted((p, u, n or "") for p, u in folk[channel] for n in known[u] if u != owner)
        return "Group: " + ", ".join(n.split(" ")[0] for p, u, n in entries if n) if entries else "Group: Zed" if owner == "U1" else "Group: N1, Zed"

    assert got == {(o, c): listed(o, c) for o, c in got}


def test_documents_are_gathered_without_their_lists(crowd):
    run = crowd()
    docs = summary.summary_documents(run, F.lit("now"))
    above = docs._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "MapInArrow" in docs._jdf.queryExecution().optimizedPlan().toString() and not re.search(r"Join|Aggregate|Repartition|Sort|Window", above)
    rows = docs.collect()
    assert {r.metadata.request.user_id: {c.channel_id for c in r.channels} for r in rows} == {**{u: {"C1", "G1"} for u in OWNERS}, "U9": set()}
    # A user whom the directory has twice has topics and channels twice, in every channel row all of them.
    shown = {(r.metadata.request.user_id, c.channel_id, t.start_time, tuple(t.participants)) for r in rows for c in r.channels for t in c.topics}
    assert shown == {(t.owner_id, t.channel, t.start_time, tuple(t.participants)) for t in run.topic_summaries.collect()}
    assert any("@Cy\nde" in t[3] and "@Bob" in t[3] for t in shown)
    assert {r.metadata.request.user_id: c.channel_name for r in rows for c in r.channels if c.channel_id == "G1"} == {
        c.owner_id: c.channel_name for c in run.channel_summaries.collect() if c.channel == "G1"}


def test_report_lines_put_in_late_are_those_of_the_report(crowd):
    run, made = crowd(), F.lit(DAY * MIN)
    early = report.report_lines(run.topic_summaries, run.channel_summaries, run.totals, run.periods, made)
    lines = report.report_lines(run.topic_facts, run.channel_facts, run.totals, run.periods, made, run)
    of = lambda rows: sorted((r.owner_id, r.line_no, r.line) for r in rows.collect())
    got = of(lines)
    assert got == of(early)
    told = {r.owner_id: r.report.split("\n") for r in report.reports(run.topic_summaries, run.channel_summaries, run.totals, run.periods, made).collect()}
    for owner in ("U1", "U3", "U9"):  # U2 has its topics twice, and lines of equal pieces take turns
        assert [line for o, _, line in got if o == owner] == told[owner]
    assert sum("de, @U4" in line for _, _, line in got) > 6 and sum(line.startswith("### Group: ") for _, _, line in got) >= 6
    above = lines._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]
    assert not re.search(r"Window|Aggregate|Sort", above)


def test_prompts_get_names_late_and_stay_with_the_model(crowd):
    def model(asked):
        return ['{"narrative": "' + p.split("\n", 1)[0].replace('"', "'") + '"}' for p in asked]

    run = crowd(model)
    told = run.topic_summaries.collect()
    named = {(c.owner_id, c.channel): c.channel_name for c in run.channel_summaries.collect()}
    assert {n.startswith("Group: ") for (_, c), n in named.items() if c == "G1"} == {True}
    for t in told:
        assert t.narrative_summary.removesuffix(" (includes thread replies)") == "Channel: #" + named[t.owner_id, t.channel].split("\n")[0]
    plain = {(t.owner_id, t.channel, t.start_us): tuple(t.participants) for t in crowd().topic_summaries.collect()}
    for t in told:
        mine = {"U1": ["@Ann Lee"], "U2": ["@Bo", "@Bob"], "U3": ["@Cy\nde"]}.get(t.owner_id, [f"@{t.owner_id}"])
        assert tuple(t.participants) == tuple(p for p in plain[t.owner_id, t.channel, t.start_us] if p not in mine), "told from the user's side"


def test_participants_are_compared_by_sets(crowd):
    run = crowd()
    own = run._own_authors.join(run.placed, ["owner_id", "period_no", "channel", "conv_id"]).select("owner_id", "channel", "cluster_id", "user_id")
    thread = run.threads.join(run.placed, ["owner_id", "period_no", "channel", "conv_id"]).select("owner_id", "period_no", "channel", "thread_us", "cluster_id").join(
        run._thread_people, ["period_no", "channel", "thread_us"]).select("owner_id", "channel", "cluster_id", "user_id")
    people = {}
    for r in own.unionByName(thread).collect():
        people.setdefault(r.cluster_id, set()).add(r.user_id)
    convs = run.conv.select("owner_id", "period_no", "channel", "conv_id")
    pairs = convs.withColumnRenamed("conv_id", "left_id").join(convs.withColumnRenamed("conv_id", "right_id"), ["owner_id", "period_no", "channel"]).filter("left_id < right_id")
    got = {(r.left_id, r.right_id): (r._ln, r._rn, r._common or 0) for r in run.common_people(pairs).collect()}
    assert len(got) > 6 and any(c for _, _, c in got.values())
    assert got == {(a, b): (len(people[a]), len(people[b]), len(people[a] & people[b])) for a, b in got}
