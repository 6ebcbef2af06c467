"""The item fixture of the query tests."""

from satchel.operators.items import item_frame

SCHEMA = "__ID__ string, __KIND__ string, type string, profession string, salary double, married boolean, members array<string>, children string"
_PERSON = lambda i, job, pay, married: {"__ID__": i, "__KIND__": "Item", "type": "Person", "profession": job, "salary": pay, "married": married}
_POSSE = lambda i, *members: {"__ID__": i, "__KIND__": "Item", "type": "Posse", "members": list(members)}
ROWS = [
    _POSSE("Good Guys", "Gandhi", "Churchill", "Jesus", "God", "Einstein"),
    _POSSE("Bad Guys", "Hitler"),
    _POSSE("Politicians", "Hitler", "Churchill"),
    _PERSON("Gandhi", "lawyer", 20000.00, True),
    _PERSON("Hitler", "politician", 100000.00, False),
    _PERSON("Churchill", "politician", 20000.50, True),
    _PERSON("Jesus", "carpenter", 0.00, False),
    {"__ID__": "God", "__KIND__": "Item", "type": "Deity", "children": "Jesus"},
    _PERSON("Einstein", "physicist", 99000.50, True),
]


def frame(spark):
    return item_frame(spark, ROWS, SCHEMA)
