import random

from pyspark.sql import functions as F

from quillspark.llm import people
from quillspark.session import Cut

SF = "/root/testdata/sf0.01"
GIVEN = "Alamintha Borwilde Castivor Delphirune Estomar Fyodorim Galandrew Hestonia Ildibrand Jorvette Kalimero Lorengard".split()
# short forms that share nothing with their names
SHORT = {"Alamintha": "Zuki", "Borwilde": "Pottle", "Castivor": "Remmo", "Delphirune": "Quay"}


def word(rng, n):
    return "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(n)).capitalize()


def slip(rng, text):
    i = rng.randrange(1, len(text) - 1)
    return rng.choice([text[:i] + text[i + 1 :], text[:i] + text[i] + text[i:], text[:i] + text[i + 1] + text[i] + text[i + 2 :]])


def planted(people_of=400, seed=3):
    """Rows (given, family, place) and the person of each: 2 to 5 spellings a person, with typing errors, initials, reversals and short names."""
    rng = random.Random(seed)
    places = [word(rng, 4) for _ in range(60)]
    rows, truth = [], []
    for p in range(people_of):
        given, family, place = rng.choice(GIVEN), word(rng, 4), rng.choice(places)
        for k in range(rng.randint(2, 5)):
            g, f, at = given, family, rng.choice(["University of {}", "Univ. of {}", "{} University", "Dept. of Law, University of {}"]).format(place)
            kind = rng.random() if k else 1
            if kind < 0.25:
                g = SHORT.get(given, given[0] + ".")
            elif kind < 0.4:
                f = slip(rng, f)
            elif kind < 0.5:
                g = slip(rng, g)
            elif kind < 0.6:
                g, f = f, g
            elif kind < 0.7:
                g = None if rng.random() < 0.5 else g
                f = f"{family}, {given}" if g is None else f
            rows.append((g, f, at))
            truth.append(p)
    return rows, truth


def pairs_of(owner):
    groups = {}
    for i, p in owner.items():
        groups.setdefault(p, []).append(i)
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


def test_recall_and_precision_of_planted_people(spark):
    rows, truth = planted()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, given string, family string, place string")
    got = pairs_of({r.id: r.person for r in people.resolve(df).collect()})
    want = pairs_of(dict(enumerate(truth)))
    assert len(got & want) / len(want) >= 0.94 and len(got & want) / len(got) >= 0.99


def test_short_names_are_learned(spark):
    rows, _ = planted()
    df = spark.createDataFrame([(i, people.form(g, f), p.split()[-1]) for i, (g, f, p) in enumerate(rows)], "pid long, form string, inst string")
    got = {r.short: r.long for r in people.short_names(df).collect()}
    assert got.items() >= {s.lower(): g.lower() for g, s in SHORT.items()}.items() - {("quay", "delphirune")} and set(got) <= {s.lower() for s in SHORT.values()}
    assert people.short_names(df.limit(0)).isEmpty()


def test_large_neighbourhoods_give_the_same_people(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/author_name.parquet").select(F.col("name_id").alias("id"), F.col("givenname").alias("given"), F.col("familyname").alias("family"), F.col("affiliation").alias("place"))
    found = [{(r.id, r.person) for r in people.resolve(df).collect()}]
    monkeypatch.setattr(people, "NEIGHBOURS", 2)
    monkeypatch.setattr(people, "RUN_BLOCK", 3)
    found.append({(r.id, r.person) for r in people.resolve(df).collect()})
    assert found[0] == found[1] and len(found[0]) == df.count()


def test_merged_profiles_match_anew(spark):
    # only the union of the first two has both the family and the institution that the third is near to
    rows = [(1, "kilowick", "ann|hettilllund"), (2, "kilowick", "ann|hettillund"), (3, "kilwick", "ann|hettilllund"), (4, "", "ann|hettillund")]
    got = {r.spelling: r.pid for r in people._persons(spark.createDataFrame(rows, "pid long, inst string, form string"), Cut(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_names_known_at_two_places_stay_apart(spark):
    rows = [(1, "Ann", "Doret", "University of Nowick"), (2, "Ann", "Doret", "University of Chilium"), (3, "Ann", "Doret", None), (4, "A.", "Doret", None), (5, "Bo", "Unknown", None), (6, "Bo C.", "Unknown", " "), (7, None, None, None)]
    got = {r.id: r.person for r in people.resolve(spark.createDataFrame(rows, "id long, given string, family string, place string")).collect()}
    assert len({got[i] for i in (1, 2, 3, 4, 7)}) == 5 and got[5] == got[6]
