"""The same derivations in DuckDB SQL, and a small assembler for ``WITH`` queries."""

CTES = {
    "lines": ((), """
        select doc_id, i as line_no, ls[i + 1] as line
        from (select doc_id, string_split(text, chr(10)) ls from documents) d, unnest(range(len(ls))) t(i)"""),
    "words": (("lines",), """
        select doc_id, line_no, j as word_no, ws[j + 1] as word
        from (select doc_id, line_no, string_split(line, ' ') ws from lines) d, unnest(range(len(ws))) t(j)"""),
    "placed": (("words",), """
        select *, coalesce(sum(length(word) + 1) over (partition by doc_id, line_no order by word_no
            rows between unbounded preceding and 1 preceding), 0) as off from words"""),
    "span": (("placed",), """
        select doc_id, (line_no // 20)::int as page_number, (line_no * 100000 + word_no)::bigint as span_id, word as text,
            72::double + off * 7.2::double as x0,
            h - ((72::double + (line_no % 20) * 16::double + (word_no % 3) * 1::double) + 12::double) as y0,
            (72::double + off * 7.2::double) + length(word) * 7.2::double as x1,
            h - (72::double + (line_no % 20) * 16::double + (word_no % 3) * 1::double) as y1,
            12::double as font_size
        from (select *, case doc_id % 4 when 0 then 792 when 1 then 1008 when 2 then 842 else 1224 end::double as h
              from placed where word <> '')"""),
    "page": (("lines",), """
        select distinct doc_id, (line_no // 20)::int as page_number,
            case doc_id % 4 when 2 then 595 when 3 then 792 else 612 end::double as width,
            case doc_id % 4 when 0 then 792 when 1 then 1008 when 2 then 842 else 1224 end::double as height,
            ((doc_id % 4) * 90)::int as rotation
        from lines where replace(line, ' ', '') <> ''"""),
    "counted": (("page",), "select doc_id, count(*)::int as page_count from page group by 1"),
    "doc": (("counted",), """
        select doc_id, 'doc.' || doc_id || '.pdf' as name, n_chars as file_size, page_count
        from documents join counted using (doc_id)"""),
    "ann": ((), """
        select event_id as ann_id, user_id % n.n as doc_id, (event_id % 3)::int as page_number, event_id as ord,
            case event_type when 'click' then 'highlight' when 'view' then 'text' when 'error' then 'redact'
                when 'purchase' then 'stamp' else 'formField' end as type,
            (40 + (event_id * 37) % 400)::double as x, ((event_id * 53) % 700)::double as y,
            (20 + (event_id % 7) * 15)::double as width, (12 + (event_id % 3) * 10)::double as height,
            'note ' || (event_id % 10) as content, value
        from events, (select count(*) as n from documents) n"""),
    "annv": (("ann", "counted"), """
        select ann_id, doc_id, (page_number % page_count)::int as page_number, ord, type, x, y, width, height, content, value
        from ann join counted using (doc_id)"""),
    "edit": ((), """
        select event_id, ts, user_id % 20 as doc_id, event_id % 40 as ann_id,
            case event_type when 'signup' then 'add' when 'click' then 'update' when 'purchase' then 'remove'
                when 'error' then 'undo' else 'redo' end as op, value
        from events"""),
    "opened": ((), """
        select event_id, ts, user_id, '/d/' || (user_id % 50) || '.pdf' as path, (user_id % 50) || '.pdf' as name
        from events where event_type = 'view'"""),
    "outline": ((), """
        select conv_id as doc_id, turn as node_id, case when turn > 0 then (turn - 1) // 2 end as parent_id,
            turn::int as ord, role || ' ' || turn as title, turn::int as page_number
        from conversations"""),
    # Reading order: lines are runs of bottom edges at most 5 pt apart, top line first.
    "gaps": (("span",), """
        select *, case when lag(y0) over (partition by doc_id, page_number order by y0 desc, x0, span_id) - y0 > 5
            then 1 else 0 end as brk from span"""),
    "lined": (("gaps",), """
        select * exclude (brk), sum(brk) over (partition by doc_id, page_number order by y0 desc, x0, span_id
            rows between unbounded preceding and current row) as line_index from gaps"""),
    "ordered": (("lined",), """
        select *, row_number() over (partition by doc_id, page_number order by line_index, x0, span_id) - 1 as read_index
        from lined"""),
    "ptext": (("ordered",), """
        select doc_id, page_number, string_agg(text, ' ' order by read_index) as text from ordered group by 1, 2"""),
    "ptext0": (("ordered",), """
        select doc_id, page_number, string_agg(text, '' order by read_index) as text from ordered group by 1, 2"""),
}


def with_tables(names, body, recursive=False):
    """``WITH`` clause for the named tables and what they need, followed by ``body``."""
    done = []

    def visit(name):
        for dep in CTES[name][0]:
            visit(dep)
        if name not in done:
            done.append(name)

    for name in names.split():
        visit(name)
    ctes = ",\n".join(f"{name} as ({CTES[name][1].strip()})" for name in done)
    body = body.strip()
    if body.lower().startswith("with "):
        raise ValueError("continue the WITH list with a leading comma instead")
    sep = "" if body.startswith(",") else "\n"
    head = "with recursive " if recursive else "with "
    return (head + ctes + sep + body) if done else body
