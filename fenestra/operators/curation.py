"""From findings to datasets: classes and tiers, a cascade of uniqueness keys and caps, greedy quota samples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenestra.checkpoints import cut
from fenestra.functions.text import repository_url, sorted_json

# Type, subtype and difficulty of findings by code; codes that need the running app; attributes that a type depends on.
CLASSES = {
    "ANDROID_XML_MISSING_ACCESSIBLE_NAME": ("accessible_name_missing", "interactive_control_missing_name", "easy"),
    "ANDROID_XML_IMAGE_BUTTON_MISSING_ACCESSIBLE_NAME": ("accessible_name_missing", "image_button_missing_name", "easy"),
    "ANDROID_XML_BUTTON_MISSING_ACCESSIBLE_NAME": ("accessible_name_missing", "button_missing_name", "easy"),
    "ANDROID_XML_INTERACTIVE_IMAGE_MISSING_ACCESSIBLE_NAME": ("accessible_name_missing", "clickable_image_missing_name", "medium"),
    "ANDROID_XML_CLICKABLE_VIEW_MISSING_ACCESSIBLE_NAME": ("accessible_name_missing", "custom_clickable_missing_name", "medium"),
    "PRESCREEN_INTERACTIVE_IMAGE_EMPTY_NAME": ("accessible_name_missing", "interactive_image_empty_description", "medium"),
    "ANDROID_XML_REPEATED_GENERIC_LABEL": ("accessible_name_quality", "repeated_generic_name", "hard"),
    "ANDROID_XML_MEANINGFUL_IMAGE_MISSING_DESCRIPTION": ("accessible_name_quality", "meaningful_image_requires_description_review", "boundary"),
    "PRESCREEN_GENERIC_ACCESSIBLE_NAME": ("accessible_name_quality", "generic_interactive_name", "hard"),
    "ANDROID_XML_INPUT_MISSING_LABEL_OR_HINT": ("input_label_hint", "input_missing_label_and_hint", "medium"),
    "ANDROID_XML_INPUT_WEAK_LABEL_OR_HINT": ("input_label_hint", "weak_input_label_or_hint", "hard"),
    "ANDROID_XML_PASSWORD_INPUTTYPE_MISSING": ("input_type_semantics", "password_input_type_missing", "hard"),
    "ANDROID_XML_EMAIL_INPUTTYPE_MISSING": ("input_type_semantics", "email_input_type_missing", "hard"),
    "ANDROID_XML_PHONE_INPUTTYPE_MISSING": ("input_type_semantics", "phone_input_type_missing", "hard"),
    "ANDROID_XML_NUMBER_INPUTTYPE_MISSING": ("input_type_semantics", "number_input_type_missing", "hard"),
    "PRESCREEN_INPUT_TYPE_SEMANTIC_CONFLICT": ("input_type_semantics", "input_type_conflicts_with_label", "hard"),
    "ANDROID_XML_LABELFOR_TARGET_MISSING": ("label_association", "label_for_target_missing", "medium"),
    "ANDROID_XML_LABELFOR_TARGET_NOT_INPUT": ("label_association", "label_for_target_requires_review", "boundary"),
    "ANDROID_XML_INTERACTIVE_NOT_FOCUSABLE": ("focus_accessibility_tree", "interactive_control_not_focusable", "hard"),
    "ANDROID_XML_UNNAMED_FOCUSABLE_CONTAINER": ("focus_accessibility_tree", "unnamed_focusable_container", "boundary"),
    "ANDROID_XML_STATEFUL_CONTROL_MISSING_LABEL": ("stateful_dynamic_value", "stateful_control_missing_label", "medium"),
    "PRESCREEN_STATEFUL_STATIC_DESCRIPTION": ("stateful_dynamic_value", "static_description_may_mask_state", "boundary"),
    "ANDROID_XML_TOUCH_TARGET_TOO_SMALL": ("touch_target_size", "explicit_touch_target_below_48dp", "medium"),
    "ANDROID_XML_TOUCH_TARGET_DIMEN_UNRESOLVED": ("touch_target_size", "touch_target_dimension_unresolved", "boundary"),  # no rule gives this code; findings under the code that one does give are left out
    "ANDROID_XML_INTERACTIVE_HIDDEN_FROM_ACCESSIBILITY": ("accessibility_attribute_conflict", "interactive_control_hidden", "hard"),
    "ANDROID_XML_INTERACTIVE_HIDDEN_BY_PARENT": ("accessibility_attribute_conflict", "interactive_child_hidden_by_parent", "boundary"),
    "ANDROID_XML_IMAGE_SEMANTICS_REQUIRES_REVIEW": ("static_xml_boundary", "image_semantics_runtime_or_visual_context", "boundary"),
    "ANDROID_XML_CUSTOM_VIEW_REQUIRES_ACCESSIBILITY_REVIEW": ("static_xml_boundary", "custom_view_runtime_semantics", "boundary"),
    "ANDROID_XML_PROGRESS_MISSING_STATUS_LABEL": ("static_xml_boundary", "dynamic_progress_status", "boundary"),
    "ANDROID_XML_NON_SEMANTIC_CLICKABLE": ("static_xml_boundary", "nonsemantic_clickable_requires_structure_or_code", "boundary"),
}
RUNTIME = ("ANDROID_XML_INTERACTIVE_HIDDEN_BY_PARENT", "ANDROID_XML_IMAGE_SEMANTICS_REQUIRES_REVIEW", "ANDROID_XML_CUSTOM_VIEW_REQUIRES_ACCESSIBILITY_REVIEW", "ANDROID_XML_PROGRESS_MISSING_STATUS_LABEL", "ANDROID_XML_NON_SEMANTIC_CLICKABLE", "PRESCREEN_STATEFUL_STATIC_DESCRIPTION")
DIFFICULTIES = ("hard", "medium", "easy", "boundary")
#: The highest score of a finding whose references aren't resolved.
UNRESOLVED_SCORE = 0.79
#: Files that the driver sees at a time when a greedy sample is drawn.
FRONTIER = 400


def confidence_label(score: Column, high: float = 0.8, medium: float = 0.5) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def candidates(findings: DataFrame, metadata: DataFrame, high: float = 0.8, medium: float = 0.5) -> DataFrame:
    """Candidate rows of findings (root, code, severity, repairability, confidence, selector, file, element, attributes, unresolved: number of needed references that aren't) with metadata (root, repository_url, commit_hash, app_name, package_name). Findings of unknown codes are left out."""
    names = F.create_map(*(x for k, v in CLASSES.items() for x in (F.lit(k), F.struct(*(F.lit(t).alias(n) for n, t in zip(("type", "subtype", "difficulty"), v))))))
    rows = findings.withColumn("_class", F.try_element_at(names, F.col("code"))).where(F.col("_class").isNotNull()).join(metadata, "root", "left")
    c = F.col
    runtime = c("code").isin(*RUNTIME) | c("repairability").isin("requires_structure_or_code", "runtime_required")
    unclear = c("unresolved") > 0
    score = F.when(unclear, F.least(c("confidence"), F.lit(UNRESOLVED_SCORE))).otherwise(c("confidence"))
    severity = F.when(unclear, "warning").otherwise(c("severity"))
    safe = (c("repairability") == "xml_safe") & ~runtime & ~unclear
    label = confidence_label(score, high, medium)
    difficulty = F.when(runtime | (c("_class.difficulty") == "boundary"), "boundary").otherwise(c("_class.difficulty"))
    status = F.when((label == "high") & (severity == "error") & safe, "candidate").when(difficulty == "boundary", "candidate").otherwise("excluded")
    ident = F.concat(F.lit("src-"), F.substring(F.sha2(F.concat_ws("|", repository_url(c("repository_url")), F.coalesce("commit_hash", F.lit("")), "file", "code", "selector"), 256), 1, 20))
    return rows.select(
        ident.alias("candidate_id"), "package_name", "app_name", "repository_url", "commit_hash", c("file").alias("xml_path"), c("element").alias("widget_type"), c("attributes")["android:id"].alias("widget_id"),
        c("_class.type").alias("issue_type"), c("_class.subtype").alias("issue_subtype"), severity.alias("severity"), label.alias("confidence"), difficulty.alias("difficulty"), safe.alias("xml_safe"), runtime.alias("runtime_required"),
        sorted_json(c("attributes")).alias("relevant_attributes"), status.alias("selection_status"), F.when(unclear, F.concat(F.lit("unresolved resources: "), c("unresolved").cast("string"))).alias("notes"), "selector", "code",
    )


def cascade(rows: DataFrame, ident: str, order: Sequence[Column | str], keys: dict[str, Sequence[str]], caps: dict[str, tuple[Sequence[str], int]]) -> DataFrame:
    """rows with exclusion_reason: what a pass in order would say, in which a row is kept unless an earlier kept one has one of its keys, or a group of it is full.

    Each round keeps the rows that fit into all their groups even if all open
    rows before them were kept, and drops those whose group is full of kept rows
    before them; so no task sees all rows, and what is open shrinks fast. A
    row's reason is the first that holds against the rows kept before it. ident
    must be unique; null keys are keys.
    """
    groups = {**{k: (c, 1) for k, c in keys.items()}, **caps}
    hashed = rows.select(ident, F.struct(*order, F.col(ident).alias("_id")).alias("at"), *(F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns)).alias(f"g_{name}") for name, (columns, _) in groups.items()))
    long = cut(hashed.select(ident, "at", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"g_{n}").alias("g"), F.lit(m).alias("most")) for n, (_, m) in groups.items()))).alias("e")).select(ident, "at", "e.*"))
    state = cut(rows.select(ident, F.lit("open").alias("state")))
    before = Window.partitionBy("name", "g").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.count_if(F.col("state") == "kept").over(before)
    while not (open_ := state.where("state = 'open'")).isEmpty():
        both = long.join(state.where("state <> 'out'"), ident)
        fits = kept + F.count_if(F.col("state") == "open").over(before) < F.col("most")
        verdict = both.withColumns({"fits": fits, "full": kept >= F.col("most")}).where("state = 'open'").groupBy(ident).agg(F.bool_or("full").alias("out"), F.bool_and("fits").alias("in"))
        moved = open_.join(verdict, ident).select(ident, F.when(F.col("out"), "out").when(F.col("in"), "kept").otherwise("open").alias("state"))
        state = cut(state.where("state <> 'open'").unionByName(moved))
    broken = long.join(state, ident).withColumn("_n", kept).where((F.col("state") == "out") & (F.col("_n") >= F.col("most")))
    rank = F.array_position(F.array(*map(F.lit, groups)), F.col("name"))
    reasons = broken.groupBy(ident).agg(F.min_by("name", rank).alias("exclusion_reason"))
    return rows.join(reasons, ident, "left")


def greedy_sample(rows: DataFrame, ident: str, app: str, file: str, kind: str, order: str, quotas: dict[str, int], per_app: int = 10, most: int = 180, new_apps_until: int = 40, frontier: int = FRONTIER) -> DataFrame:
    """(ident, pick): a sample that fills quotas by kind: next comes a row of the app with most kinds still wanted, of an app already in (or, until there are ``new_apps_until``, a new one), of a file already in, of the file with most rows to offer, of the app with fewest picks, then by order; at most per_app of an app.

    What a file offers can only shrink, and no file moves up but by a pick of it
    or of its app. So Spark ranks all files under the picks so far and sends the
    best ``frontier``, each with its counts and the first rows of each kind (no
    more than an app may give); picks are made among them as long as they beat
    the last one sent. The picks are those of a pass over the whole pool.
    """
    c = F.col
    pool = rows.where(c(kind).isin(list(quotas))).select(c(ident).alias("i"), c(app).alias("app"), c(file).alias("file"), c(kind).alias("kind"), c(order).alias("o"))
    first = F.row_number().over(Window.partitionBy("app", "file", "kind").orderBy("o", "i"))
    heads = pool.withColumn("_n", first).where(c("_n") <= per_app).groupBy("app", "file", "kind").agg(F.array_sort(F.collect_list(F.struct("o", "i"))).alias("heads"))
    counts = pool.groupBy("app", "file", "kind").agg(F.count("*").alias("n"))
    files = cut(counts.join(heads, ["app", "file", "kind"]))
    spark, types = rows.sparkSession, dict(pool.dtypes)
    wanted, apps, inside = Counter(quotas), Counter(), set()
    taken: Counter = Counter()  # by app, file and kind
    picks: list = []
    while len(picks) < most and any(n > 0 for n in wanted.values()):
        fresh, open_kinds, gone = len(apps) < new_apps_until, [k for k, n in wanted.items() if n > 0], set(picks)
        of_files = spark.createDataFrame([(*k, n) for k, n in taken.items()], f"app {types['app']}, file {types['file']}, kind {types['kind']}, taken long")
        of_apps = spark.createDataFrame(list(apps.items()), f"app {types['app']}, picked long")
        # What has been picked is bounded by ``most``, so it is broadcast.
        offered = files.where(c("kind").isin(open_kinds)).join(F.broadcast(of_files), ["app", "file", "kind"], "left").withColumn("n", c("n") - F.coalesce("taken", F.lit(0))).where("n > 0")
        offered = offered.join(F.broadcast(of_apps), "app", "left").withColumn("picked", F.coalesce("picked", F.lit(0))).where(c("picked") < per_app)
        kinds = offered.groupBy("app").agg(F.collect_set("kind").alias("kinds"))
        by_file = offered.groupBy("app", "file", "picked").agg(F.sum("n").alias("offers"), F.map_from_entries(F.collect_list(F.struct("kind", F.struct("n", "heads")))).alias("by_kind"))
        touched = F.broadcast(spark.createDataFrame([(a, f) for a, f in inside], f"app {types['app']}, file {types['file']}").withColumn("known", F.lit(True)))
        ranked = by_file.join(touched, ["app", "file"], "left").join(kinds, "app")
        ranked = ranked.withColumn("best", F.array_min(F.flatten(F.transform(F.map_values("by_kind"), lambda v: F.filter(v["heads"], lambda h: ~h["i"].isin(list(gone)) if gone else F.lit(True))))))
        ranked = ranked.orderBy(-F.size("kinds"), ((c("picked") > 0) == F.lit(fresh)).cast("int"), c("known").isNull().cast("int"), -c("offers"), "picked", "best.o", "best.i")
        sent = ranked.limit(frontier).collect()
        if not sent:
            break
        app_kinds = {r.app: set(r.kinds) for r in sent}
        left = {(r.app, r.file, k): [v["n"], [h for h in v["heads"] if h["i"] not in gone]] for r in sent for k, v in r.by_kind.items()}
        # A kind that an app offers in files that aren't here is there as long as it is wanted.
        here: dict = {a: Counter() for a in app_kinds}
        for (a, _, k), (n, _) in left.items():
            here[a][k] += n
        elsewhere = {a: ks - set(here[a]) for a, ks in app_kinds.items()}

        def key(a, f) -> tuple | None:
            mine = [(k, *left[a, f, k]) for k in quotas if (a, f, k) in left and wanted[k] > 0 and left[a, f, k][0] > 0]
            if not mine or apps[a] >= per_app:
                return None
            best = min((h["o"], h["i"], k) for k, _, hs in mine for h in hs[:1])
            return (-sum(wanted[k] > 0 and (k in elsewhere[a] or here[a][k] > 0) for k in app_kinds[a]), (a in apps) == fresh, (a, f) not in inside, -sum(n for _, n, _ in mine), apps[a], *best)

        complete = len(sent) < frontier
        bound = key(sent[-1].app, sent[-1].file)
        whole = {a for a in app_kinds} if complete else set()
        while len(picks) < most:
            best = min(((k, r.app, r.file) for r in sent if (k := key(r.app, r.file)) is not None), default=None)
            if best is None or (not complete and best[0] > bound):
                break
            (*_, i, kind_), a, f = best
            new = a not in apps
            n, hs = left[a, f, kind_]
            left[a, f, kind_] = [n - 1, hs[1:]]
            here[a][kind_] -= 1
            taken[a, f, kind_] += 1
            apps[a] += 1
            inside.add((a, f))
            wanted[kind_] -= 1
            picks.append(i)
            # A new app moves its other files up once new apps aren't wanted; so does the turn from one to the other. A kind that runs out here may be left in files that aren't.
            if (len(apps) < new_apps_until) != fresh or (new and not fresh and a not in whole) or (n == 1 and not complete):
                break
    return spark.createDataFrame([(i, at) for at, i in enumerate(picks)], f"{ident} {types['i']}, pick int")


def evidence_count(rows: DataFrame, ident: str, sources: Sequence[str], terms: set[str]) -> DataFrame:
    """(ident, evidence): how many of the source columns speak of the terms; two are needed for a sure purpose."""
    from fenestra.functions.text import has_term

    hits = F.array_compact(F.array(*(F.when(has_term(F.coalesce(F.col(s), F.lit("")), terms), F.lit(s)) for s in sources)))
    return rows.select(ident, F.size(hits).alias("evidence"), F.array_join(hits, ";").alias("found_in"))


def score_layout(counts: dict[str, tuple[Column, float, float]], disqualified: Column, threshold: float = 50) -> tuple[Column, Column]:
    """(score, accepted): a sum of weighted counts, each up to a maximum, zero if disqualified."""
    total = F.lit(0.0)
    for count, weight, maximum in counts.values():
        total = total + F.least(count * weight, F.lit(maximum))
    score = F.when(disqualified, 0.0).otherwise(total)
    return score, score >= threshold


# What in a layout's text tells that a repository is worth a look.
MARKERS = {
    "input_widget": r"<(?:[\w.]*EditText|[\w.]*AutoCompleteTextView)\b",
    "input_type": r"(?:android:)?inputType\s*=",
    "label_for": r"(?:android:)?labelFor\s*=",
    "important_no": r"importantForAccessibility\s*=\s*[\"'](?:no|noHideDescendants)[\"']",
    "focusable_false": r"focusable\s*=\s*[\"']false[\"']",
    "clickable": r"(?:clickable\s*=\s*[\"']true[\"']|android:onClick\s*=)",
}


def marker_counts(layouts: DataFrame, by: Sequence[str], content: str) -> DataFrame:
    """(by, a count for each marker, worth): markers in all of a group's layouts, counted file by file before the shuffle."""
    counts = layouts.groupBy(*by).agg(*(F.sum(F.coalesce(F.regexp_count(content, F.lit(p)), F.lit(0))).alias(n) for n, p in MARKERS.items()))
    some = lambda *names: F.greatest(*(F.col(n) for n in names)) > 0 if len(names) > 1 else F.col(names[0]) > 0
    return counts.withColumn("worth", some("label_for", "important_no", "focusable_false") | (some("input_widget") & some("input_type")))


def chosen(rows: DataFrame, name: str, wanted: Sequence[str]) -> DataFrame:
    """The rows of the wanted names; a name that no row has is an error."""
    names = rows.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(wanted)], f"{name} string")
    unknown = [r[0] for r in names.join(rows.select(name).distinct(), name, "left_anti").orderBy(name).collect()]  # at most the wanted names
    if unknown:
        raise ValueError(f"unknown {name}: {', '.join(unknown)}")
    return rows.join(names, name, "left_semi")
