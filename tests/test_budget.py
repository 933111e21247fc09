"""The token budget falls monotonically and keeps at least one file."""

from corvane.operators.budget import Index, apply_budget
from corvane.plans.catalog import Code


def test_budget(spark):
    c = Code(spark, "/root/testdata/sf0.001")
    index = Index(c.files.cache(), c.decls.cache(), c.imports.cache(), c.rels.cache())
    full = index.tokens()
    assert apply_budget(index, full)[1] == 0
    one, stage = apply_budget(index, full - 1)
    assert stage == 1 and one.tokens() < full and one.decls.count() == index.decls.count()
    last, stage = apply_budget(index, 10)
    assert stage == 5 and last.files.count() == 1
    some, stage = apply_budget(index, 1500)
    assert stage == 5 and 1 <= some.files.count() < index.files.count() and some.tokens() <= 1500
