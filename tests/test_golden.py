"""Whole specifications on whole objects."""

from specloom.objects import ObjectMapper


def test_oven_readings(spark):
    """An expression over a nested object, by its unit."""
    schema = {"classes": {"Reading": {"attributes": {"oven": {}, "heat": {"range": "Heat", "inlined": True}}}, "Heat": {"attributes": {"degrees": {"range": "float"}, "scale": {}}}}}
    spec = {"class_derivations": {"Reading": {"slot_derivations": {"oven": None, "kelvin": {"expr": "case((heat.scale == 'K', heat.degrees), (heat.scale == 'C', heat.degrees + 273.15))"}}}}}
    m = ObjectMapper(spark, spec, schema)
    rows = [{"oven": "north", "heat": {"degrees": 450.0, "scale": "K"}}, {"oven": "south", "heat": {"degrees": 100.0, "scale": "C"}}, {"oven": "east", "heat": {"degrees": 1.0, "scale": "?"}}, {"oven": "west", "heat": None}]
    assert m.transform_many(rows, "Reading") == [{"oven": "north", "kelvin": 450.0}, {"oven": "south", "kelvin": 373.15}, {"oven": "east", "kelvin": None}, {"oven": "west", "kelvin": None}]


def test_library_loans(spark):
    """References between the objects of one container, by identifier."""
    schema = {"classes": {
        "Library": {"tree_root": True, "attributes": {"loans": {"range": "Loan", "multivalued": True, "inlined_as_list": True}, "books": {"range": "Book", "multivalued": True, "inlined": True}}},
        "Loan": {"attributes": {"book": {"range": "Book"}, "days": {"range": "integer"}}},
        "Book": {"attributes": {"isbn": {"identifier": True}, "title": {}, "shelf": {"range": "integer"}}},
    }}
    spec = {"class_derivations": {
        "Library": {"slot_derivations": {"lent": {"populated_from": "loans"}}},
        "Lent": {"populated_from": "Loan", "slot_derivations": {"which": {"populated_from": "book"}, "label": {"expr": "book.title + ' @' + str(book.shelf)"}, "weeks": {"expr": "days // 7"}}},
    }}
    books = {"b-7": {"title": "Tides", "shelf": 4}, "b-9": {"title": "Moss", "shelf": 11}}
    got = ObjectMapper(spark, spec, schema).map_object({"loans": [{"book": "b-9", "days": 20}, {"book": "b-7", "days": 7}, {"book": "lost", "days": 3}], "books": books})
    assert got == {"lent": [{"which": "b-9", "label": "Moss @11", "weeks": 2}, {"which": "b-7", "label": "Tides @4", "weeks": 1}, {"which": "lost", "label": None, "weeks": 0}]}


def test_parcel_labels(spark):
    """Datatypes and identifiers of another form on the way."""
    schema = {"prefixes": {"depot": "https://parcels.test/depot/"}, "classes": {"Parcel": {"attributes": {"at": {"range": "uriorcurie"}, "page": {"range": "uri"}, "grams": {"range": "integer"}, "code": {}}}}}
    spec = {"class_derivations": {"Label": {"populated_from": "Parcel", "slot_derivations": {"depot": {"populated_from": "at", "range": "uri"}, "page": {"populated_from": "page", "range": "curie"}, "grams": {"populated_from": "grams", "range": "string"}, "code": {"populated_from": "code", "range": "integer"}}}}}
    got = ObjectMapper(spark, spec, schema).transform_many([{"at": "depot:12", "page": "https://parcels.test/depot/12/map", "grams": 250, "code": "0042"}], "Parcel")
    assert got == [{"depot": "https://parcels.test/depot/12", "page": "depot:12/map", "grams": "250", "code": 42}]


def test_single_signal_for_several(spark):
    """One value where several may stand, through an enum."""
    schema = {"classes": {"Line": {"tree_root": True, "attributes": {"posts": {"range": "Post", "multivalued": True, "inlined_as_list": True}}}, "Post": {"attributes": {"lamps": {"range": "Lamp", "multivalued": True}}}}, "enums": {"Lamp": {"permissible_values": {"r": {}, "g": {}}}}}
    spec = {"class_derivations": {"Line": {"slot_derivations": {"signals": {"populated_from": "posts"}}}, "Signal": {"populated_from": "Post", "slot_derivations": {"shows": {"populated_from": "lamps"}}}}, "enum_derivations": {"Aspect": {"populated_from": "Lamp", "permissible_value_derivations": {"STOP": {"populated_from": "r"}, "GO": {"populated_from": "g"}}}}}
    got = ObjectMapper(spark, spec, schema).map_object({"posts": [{"lamps": ["g", "r"]}, {"lamps": "r"}, {"lamps": []}]})
    assert got == {"signals": [{"shows": ["GO", "STOP"]}, {"shows": ["STOP"]}, {"shows": []}]}


def test_tariffs(spark):
    """A registered table: the first row of a key counts, a null key finds nothing."""
    schema = {"classes": {"Call": {"attributes": {"zone": {}}}, "Tariff": {"attributes": {"zone": {}, "cents": {"range": "integer"}}}}}
    spec = {"class_derivations": {"Call": {"joins": {"Tariff": {"join_on": "zone"}}, "slot_derivations": {"cents": {"populated_from": "Tariff.cents"}}}}}
    m = ObjectMapper(spark, spec, schema).register_join_table("Tariff", [{"zone": "z1", "cents": 9}, {"zone": "z1", "cents": 30}], "zone")
    assert m.transform_many([{"zone": "z1"}, {"zone": "z2"}, {"zone": None}], "Call") == [{"cents": 9}, {"cents": None}, {"cents": None}]
    assert m.validate() == []
