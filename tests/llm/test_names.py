from conftest import rows
from quire.llm import names as N

AGENTS = [
    {"agent_id": 1, "agent_kind": "person", "agent_name": "Margaret A. Wexomüller"}, {"agent_id": 2, "agent_kind": "person", "agent_name": "Robert Noramdale"}, {"agent_id": 3, "agent_kind": "person", "agent_name": "Raymond Noramdale"},
    {"agent_id": 4, "agent_kind": "publisher", "agent_name": "Brickfield University Press Inc."}, {"agent_id": 5, "agent_kind": "publisher", "agent_name": "Brickfield Books"}, {"agent_id": 6, "agent_kind": "person", "agent_name": None}, {"agent_id": 7, "agent_kind": "person", "agent_name": "Margaret Quillfen"}, {"agent_id": 8, "agent_kind": "person", "agent_name": "Robert Tarnholt"}, {"agent_id": None, "agent_kind": None, "agent_name": "Robert Noramdale"}, {"agent_id": None, "agent_kind": None, "agent_name": "Robert Noramdale"},
]


CASES = [
        ("Wexomüller, Margaret", 1), ("M. Wexomuller", 1), ("MA Wexomüller", 1), ("Peggy Wexomüller", 1), ("Dr. Margaret Wexomüler", 1), ("Wexomüller M", 1), ("MARGARET WEXOMÜLLER (ed.)", 1), ("Wexomüller, Margaret, 1950-", 1), ("Margaret\u00a0Wexоmüller", 1), ("Margaret B. Wexomüller", None),
        ("Bob Noramdale", 2), ("Bob Tarnholt", 8), ("Peggy Quillfen", 7), ("Will Quillfen", None), ("R. Noramdale", None), ("Walter Noramdale", None), ("Ray Noramdale", 3), ("Robert Noramdale; Ann Roe", None), ("Robert Noramdale, Ann Roe", None),
        ("The Brickfield University Press", 4), ("Brickfield Univ. Pr.", 4), ("Univ. Pr. Brickfield", 4), ("Brickfeild University Press GmbH", 4), ("Brickfield Books & Co.", 5), ("Books Brickfield", 5), ("Brickfield UniversityPress", 4), ("Brickfield UniversityP ress", 4), ("Brickfield", None), ("n/a", None), (" ", None), ("", None), (None, None),
]


def test_links(spark, make):
    d = make(books=[{"book_id": i, "authors": [m], "publisher": None} for i, (m, _) in enumerate(CASES)] + [{"book_id": 900, "authors": ["Margaret A. Wexomüller", None], "publisher": "Brickfield Books"}], opf_metadata=[{"book_id": 1, "creators": ["Noramdale, Bob", "Robert Noramdale"]}, {"book_id": 2, "creators": None}], agents=AGENTS)
    got = {(r["book_id"], r["field"], r["pos"]): r["agent_id"] for r in N.p6_found(spark, d).collect()}
    assert got.pop((1, "opf_metadata.creators", 1)) == 2
    assert {k[0]: v for k, v in got.items()} == {i: a for i, (_, a) in enumerate(CASES) if a is not None}
    assert N.p6_found(spark, make(books=[], opf_metadata=[], agents=[])).count() == 0


def test_profiles_grow_until_nothing_merges(spark):
    agents = [(1, "person", "Margaret Anna Wexomueller"), (2, "publisher", "Brickfield University Press"), (3, "person", "Katherine Noramdale"), (4, "person", "Walter Abcdefghij")]
    family, steps = "abcdefghij", []
    for i in range(6):  # one more letter exchanged in each mention: one round for each
        family = family[:i] + "z" + family[i + 1 :]
        steps.append(f"Walter {family}")
    want = {
        "Margarete Wexomueller": 1, "Margarethe Wexomueller": 1, "Margaret Anne Wexomueller": 1, "Margaret Annie Wexomueller": 1, "Margarethes Wexomuller": None,
        "Brickfeild University Press": 2, "Brickfeilds Univ. Pr.": 2, "Univ. Pr. Brickfeilds": 2, "Brickfeilds UniversityPress": 2,
        "Catherine Noramdale": 3, "C. Noramdale": 3, "D. Noramdale": None, **dict.fromkeys(steps, 4), "Walter Klmnopqrst": None,
    }
    mentions = spark.createDataFrame([(m,) for m in want], "mention string")
    got = {r["mention"]: r["agent_id"] for r in N.resolve(mentions, spark.createDataFrame(agents, "agent_id int, agent_kind string, agent_name string")).collect()}
    assert got == {m: a for m, a in want.items() if a}


def test_forms_are_learned_for_names_that_the_code_does_not_hold(spark):
    import random

    r = random.Random(4)
    given = {"Obrekzan": "Tudl", "Miruvelda": "Fenny", "Kestorin": "Wub", "Halvuqua": "Ibsi", "Zorentip": "Gax", "Benvolar": "Ben"}
    trade = {"Drukkerhaus": "Dkh", "Skrifverk": "Skv", "Bokmakeri": "Zunft"}
    agents, mentions = [], {}
    for i in range(60):
        first, family = list(given)[i % 6], "".join(r.choice(["lor", "vun", "keb", "sti", "mag", "dro", "pel"]) for _ in range(4)).capitalize() + "xyzqw"[i % 5]
        agents.append((i, "person", f"{first} {family}"))
        typo = family[:3] + r.choice("aeiou") + family[4:] if r.random() < 0.5 else family[:3] + family[4:]
        for m in (f"{given[first]} {family}", f"{family}, {given[first]}", f"{first} {typo}", f"{first[0]}. {family}", f"{first.upper()} {family.upper()}"):
            mentions[m] = i
    for i in range(60, 81):
        word, own = list(trade)[i % 3], "".join(r.choice(["oak", "fen", "rill", "carn", "wyv", "holt"]) for _ in range(3)).capitalize() + "gjk"[i % 3]
        agents.append((i, "publisher", f"{own} {word} Ltd."))
        for m in (f"{own} {trade[word]}", f"{own} {word}", f"The {word} {own}", f"{own[:2] + own[3:]} {word}"):
            mentions[m] = i
    nobody = [f"{g} Unrelatedson{k}" for k in range(20) for g in ("Tudl", "Obrekzan")] + [f"Strange{k} Dkh" for k in range(9)]
    frame = spark.createDataFrame([(m,) for m in [*mentions, *nobody]], "mention string")
    got = {x["mention"]: x["agent_id"] for x in N.resolve(frame, spark.createDataFrame(agents, "agent_id int, agent_kind string, agent_name string")).collect()}
    right = sum(got.get(m) == a for m, a in mentions.items())
    assert right >= 0.95 * len(mentions), [m for m, a in mentions.items() if got.get(m) != a]
    assert not set(nobody) & set(got)


def test_short_forms_and_abbreviations():
    assert N.short_form("ben", "benjamin") and N.short_form("mike", "michael") and N.short_form("mick", "michael") and not N.short_form("bob", "robert")
    assert N.abbreviates("vlg", "verlag") and N.abbreviates("univ", "university") and not N.abbreviates("books", "bookshops") and not N.abbreviates("pr", "books")


def test_names_of_the_same_family_teach_nothing(spark):
    agents = [(1, "person", "Eleanor Drayensen"), (2, "person", "Walter J. Drayensen"), (3, "person", "Eleanor Ostinholt"), (4, "person", "Walter B. Ostinholt")]
    want = {"Walter Draynsen": 2, "Waletr Drayensen": 2, "Walter K. Drayensen": None, "Walter C. Ostinholt": None, "Walterr X. Ostinholt": None, "Eleanor Draynsen": 1, "Walter Ostinholt": 4}
    mentions = spark.createDataFrame([(m,) for m in want], "mention string")
    got = {r["mention"]: r["agent_id"] for r in N.resolve(mentions, spark.createDataFrame(agents, "agent_id int, agent_kind string, agent_name string")).collect()}
    assert got == {m: a for m, a in want.items() if a}


def test_forms_are_counted_in_one_reading(spark):
    left = spark.createDataFrame([([x],) for x in ("noramdale\tbob", "tarnholt\tbob", "noramdale\tray", "quillfen\twill", "noramdale\trobert")], "pairs array<string>")
    halves = spark.createDataFrame([(x,) for x in (["verlag\tvlg\tbrick"], ["verlag\tvlg\tstone", "books\tvlg\tstone"], ["verlag\tvlg\tstone"], ["books\tbks\tstone"], [])], "new array<string>")
    profiles = spark.createDataFrame([N.profile(i, "person", n) for i, n in enumerate(("Robert Noramdale", "Raymond Noramdale", "Robert Tarnholt", "Margaret Quillfen"))], N.PROFILE)
    forms = N.forms_of(left, halves, profiles)
    assert forms._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # each reading more is a broadcast and several stages a round, which the driver pays for
    assert {tuple(r) for r in forms.collect()} == {("g", "robert", "bob"), ("g", "raymond", "ray"), ("w", "verlag", "vlg")}
