"""Weekly release by recovery tables of two seasons (eight release weeks, weeks 19-26).

Rows are release weeks, columns recovery weeks and "never seen again"; the last row is the unmarked catch.
"""

SEASON_A = (
    (8, 2, 0, 0, 0, 0, 0, 0, 52),
    (0, 4, 14, 0, 0, 0, 0, 0, 28),
    (0, 0, 60, 47, 0, 0, 0, 0, 81),
    (0, 0, 0, 221, 164, 0, 0, 0, 618),
    (0, 0, 0, 0, 1047, 87, 0, 0, 1618),
    (0, 0, 0, 0, 0, 389, 79, 0, 823),
    (0, 0, 0, 0, 0, 0, 8, 3, 174),
    (0, 0, 0, 0, 0, 0, 0, 6, 11),
    (157, 82, 782, 2890, 3400, 2252, 637, 167, 0),
)
SEASON_B = (
    (10, 9, 0, 0, 0, 0, 0, 0, 51),
    (0, 31, 43, 0, 0, 0, 0, 0, 126),
    (0, 0, 210, 41, 0, 0, 0, 0, 798),
    (0, 0, 0, 146, 257, 0, 0, 0, 1377),
    (0, 0, 0, 0, 226, 27, 0, 0, 1112),
    (0, 0, 0, 0, 0, 71, 37, 0, 248),
    (0, 0, 0, 0, 0, 0, 126, 5, 89),
    (0, 0, 0, 0, 0, 0, 0, 14, 82),
    (149, 219, 2739, 3201, 4123, 1209, 799, 181, 0),
)
POOLS = (1, 1, 3, 4, 5, 6, 8, 8)


def matrix_rows(table, season):
    """Long rows (season, release_week, recover_week, kind, n) with weeks as Mondays."""
    import datetime as dt

    monday = [dt.date(2024, 5, 6) + dt.timedelta(weeks=i) for i in range(8)]
    rows = []
    for i in range(8):
        rows += [(season, monday[i], monday[j], "recovered", float(table[i][j])) for j in range(8) if table[i][j]]
        rows.append((season, monday[i], None, "never", float(table[i][8])))
    rows += [(season, None, monday[j], "unmarked", float(table[8][j])) for j in range(8)]
    return rows
