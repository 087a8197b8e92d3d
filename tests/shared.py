"""Names that tests of both kinds use."""

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(df, con, sql):
    """Both results as sorted rows of text, columns by name."""
    names = sorted(df.columns)
    mine = sorted(tuple(str(v) for v in r) for r in df.select(*names).collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    at = [cols.index(n) for n in names]
    theirs = sorted(tuple(str(r[i]) for i in at) for r in cur.fetchall())
    assert mine == theirs
    return len(mine)
