from graphloom.llm.names import Reading, alike, compare, components, distance, drops, identities, name_pairs, strong_forms

SAME = {
    "ann": ["Antonia Berglindqvist", " BERGLINDQVIST, Antonia", "Dr. Antonia B. Berglindqvist", "Antonia Berglindqvist, PhD", "Toni Berglindqvist", "A. Berglindqvist", "Antonía  Berglìndqvist", "Antonia Bergl1ndqvist", "antonia.berglindqvist", "Antonia Bergilndqvsit", "Prof. Berglindqvist", "aberglindqvist", "Prof. Berglidnqvist", "A. Berglindqist", "Antonia Berg-Lindqvist"],
    "rob": ["Robert Berglandsson", "Bob Berglandsson"],
    "carl": ["Carl Oberhauser"],
    "dora": ["Dora Oberhauser"],
    "mus": ["Kelvatun Museum of Zoology", "The Kelvatun Museum of Zoology", "Kelvatun Mus. of Zool.", "KELVATUN ZOOLOGY MUSEUM", "Kelvatun MZ", "Kelvtaun Museum for Zoology", "Museum of Zoology, Kelvatun", "Kelvatun"],
    "com": ["Norvagen Steel & Optics Ltd", "Norvagen Steel and Optics Limited", "Norvagen Ste. & Optics", "NORVAGEN STEEL & OPTICS LTD "],
    "gen": ["Norvagen Steel & Botany Ltd"],
    "col": ["Hodtadad College of Logistics"],
    "lin": ["Hodtadad College of Linguistics"],
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, name string, canonical_name string, entity_type string, key string, label string")


def test_variants_are_linked_and_lookalikes_are_not(spark):
    rows = [(f"{g}{i}", n, None, "PERSON" if g in ("ann", "rob", "carl", "dora") else "Organization", "x", "y") for g, names in SAME.items() for i, n in enumerate(names)]
    rows += [("weak", "Oberhauser", None, "PERSON", "x", "y"), ("clean", "D. Oberhauser", "Dora Oberhauser", None, "x", "y")]
    rows += [(f"lake{i}", n, None, "LOCATION", "x", "y") for i, n in enumerate(["Lake Dagamam", "Lake Dagaman", "LAKE DAGAMAM", "Lake Vulelum", "Dagamam vessel 2", "Dagamam vessel 3"])]
    rows += [("n1", None, None, None, None, None), ("n2", "", " ", None, None, None), (None, "Carl Oberhauser", None, None, None, None), ("x" * 50, "word " * 4000, None, "PERSON", None, None), rows[0]]
    nick = spark.createDataFrame([("Toni", "Antonia"), ("Toni", "Anton"), ("Bob", "Robert"), (None, "X"), ("Y", None)], "nickname string, given_name string")
    got = {tuple(r) for r in name_pairs(identities(frame(spark, rows), nick)).collect()}
    groups = [[f"{g}{i}" for i in range(len(names))] for g, names in SAME.items()]
    groups[3].append("clean")
    want = {tuple(sorted((a, b))) for g in groups for a in g for b in g if a != b}
    assert got == want


def test_empty_tables(spark):
    nick = spark.createDataFrame([], "nickname string, given_name string")
    assert name_pairs(identities(frame(spark, []), nick)).count() == 0


def test_words_and_readings():
    assert distance("abcd", "abdc") == 1 and distance("abcd", "xycd") == 2 and distance("a", "abcd") == 3
    assert alike("mokiven", "mokiveri") and alike("berglind", "bergilnd") and not alike("carl", "dora") and not alike("abc", "abd")
    for a, b in (("abcdefgh", "abdcefxh"), ("abcd", "abxd"), ("abcd", "abc")):
        assert drops(a) & drops(b)
    assert Reading("Nidkulguh, Fikuke L.").key == Reading("Fikuke Nidkulguh").key == "p|fikuke|nidkulguh"
    # Cut-off words are no longer part of a shared key: the whole name is found by a form and checked by full words.
    short, whole = Reading("Zimzudad Paper. Logis.").key, Reading("Zimzudad Paper & Logistics S.A.").key
    assert strong_forms(short) & strong_forms(whole) and compare(short, whole)[0] == "abbr"
    assert Reading("V.\xa0Hitlumvav").key == "i|v|hitlumvav" and Reading("Tememoh estimate 2").layer == -1
    for a, b in (("Acme Consulting Ltd", "Acme Construction Ltd"), ("Acme Marine Services Ltd", "Acme Market Services Ltd"), ("Acme Transport GmbH", "Acme Translations GmbH"), ("X Institute of Geology", "X Institute of Geodesy")):
        assert Reading(a).key != Reading(b).key and compare(Reading(a).key, Reading(b).key) is None
    for n, kind in (("Maria del Carmen Garcia Lopez", "p"), ("Jean Claude Van Damme", "p"), ("Area 51 Ltd", "o"), ("Studio 54 GmbH", "o"), ("Иван Петров", "p"), ("王小明", "p"), ("李 明", "p"), ("Bo Li", "p"), ("Jose Xu", "p"), ("Anh Ng", "p"), ("Kelvatun MZ", "o"), ("A B", "p"), ("???", "x"), ("Dr.", "x")):
        assert Reading(n).kind == kind and Reading(n).key, n
    assert Reading("Petrov, Ivan").key == Reading("Ivan Petrov").key and Reading("Петров, Иван").key == Reading("иван ПЕТРОВ").key
    assert Reading("Ludwig van Beethoven").key == Reading("Beethoven, Ludwig").key


def test_components_of_a_long_chain(spark):
    n = 70
    edges = spark.createDataFrame([(f"{(i * 37) % n:03d}", f"{((i + 1) * 37) % n:03d}") for i in range(n - 1)] + [("x", "y"), ("z", "z")], "a string, b string")
    got = {r.node: r.label for r in components(edges).collect()}
    assert {got[f"{i:03d}"] for i in range(n)} == {"000"} and got["y"] == "x" and got["z"] == "z"


def _identity(spark, names, nick=(), kind="PERSON"):
    rows = [(f"e{i}", n, None, kind, None, None) for i, n in enumerate(names)]
    table = spark.createDataFrame(list(nick), "nickname string, given_name string")
    return {r.id: r for r in identities(frame(spark, rows), table).collect()}


def test_given_names_in_use_are_not_mistyped_ones(spark):
    pairs = [("Daniel", "Daniela", "Smith"), ("Christian", "Christina", "Meyer"), ("Mark", "Mary", "Jones"), ("Joan", "John", "Baker"), ("Maria", "Marie", "Lopez")]
    others = ["Oldfield", "Underhill", "Fairweather"]
    names = [f"{g} {s}" for a, b, s in pairs for g in (a, b)] + [f"{g} {s}" for a, b, _ in pairs for g in (a, b) for s in others]
    got = _identity(spark, [*names, "Daniel Smiht", "Crhistina Meyer", "Marrk Jones"])
    assert len(got) == len(names) + 3 and all(r.score == 1 for r in got.values())
    same = lambda i, j: got[f"e{i}"].identity == got[f"e{j}"].identity
    assert not any(same(2 * i, 2 * i + 1) for i in range(len(pairs)))
    n = len(names)
    assert same(n, 0) and same(n + 1, 3) and same(n + 2, 4) and not same(n + 2, 5)
    listed = _identity(spark, ["Daniel Smith", "Daniela Smith", "Danny Smith"], [("Danny", "Daniel"), ("Ella", "Daniela")])
    assert listed["e0"].identity == listed["e2"].identity != listed["e1"].identity


def test_every_name_has_an_identity(spark):
    names = ["Maria del Carmen Garcia Lopez", "GARCIA LOPEZ, Maria Carmen", "Иван Петров", "Петров, Иван", "王小明", "王小明 ", "Area 51 Ltd", "Area 51", "Area 51 Limited", "Bo Li", "Li, Bo", "bo li", "Carl Oberhauser", "Dora Oberhauser", "Oberhauser", "Oberhauser ", "???", "Anna Maria Oldfield", "Anna Oldfield", "Acme Cons. Ltd", "Acme Consulting Ltd", "Acme Construction Ltd", "Zed Cons. Ltd", "Zed Consulting Ltd", "Qed Opt. Ltd", "Qed Opti. Ltd"]
    got = _identity(spark, names, kind=None)
    assert len(got) == len(names)
    same = lambda i, j: got[f"e{i}"].identity == got[f"e{j}"].identity
    for i, j in ((0, 1), (2, 3), (4, 5), (6, 8), (9, 10), (9, 11), (17, 18), (22, 23), (24, 25)):
        assert same(i, j), (names[i], names[j])
    for i, j in ((12, 13), (12, 14), (13, 14), (19, 20), (19, 21), (20, 21), (2, 4)):
        assert not same(i, j), (names[i], names[j])
    assert got["e14"].score == 0.5  # one of two persons: not linked, but kept


def test_digits_and_types(spark):
    got = _identity(spark, ["Studio 54", "studio 54", "Studio 55"], kind="Organization")
    assert got["e0"].identity == got["e1"].identity != got["e2"].identity and got["e0"].kind == "o"
    assert _identity(spark, ["Studio 54"], kind="EVENT")["e0"].kind == "x"


def test_no_table_of_names_is_sent_through_the_driver(spark):
    rows = [(f"{g}{i}", n, None, "PERSON", "x", "y") for g, names in SAME.items() for i, n in enumerate(names)]
    nick = spark.createDataFrame([("Toni", "Antonia")], "nickname string, given_name string")
    plans = spark._jsparkSession.sharedState().statusStore()
    before = plans.executionsCount()
    assert name_pairs(identities(frame(spark, rows), nick)).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = plans.executionsList()
    texts = [ran.apply(i).physicalPlanDescription() for i in range(ran.size()) if ran.apply(i).executionId() >= before]
    assert any("SortMergeJoin" in t for t in texts) and not [t for t in texts if "Broadcast" in t]
