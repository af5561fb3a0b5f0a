"""Input tables derived from the given ones, as SQL that Spark and DuckDB both run.

``pages`` holds no forms, script files, bucket names or provider answers, so inputs for those operators are plain
projections and joins of it. Each grows with the table it is derived from. Where one statement would make Spark
compare all pairs, it has a Spark text of its own with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOST = "split_part(split_part(url, '://', 2), '/', 1)"
DOMAIN = "regexp_extract(url, '([^./]+[.][a-z]+)(/|$)', 1)"
ID = "cast(page_id as varchar(20))"

SQL: dict[str, str] = {
    "captures": """
        select page_id, url, html,
          case when page_id % 10 = 7 then 404 when page_id % 10 = 8 then 500 when page_id % 10 = 9 then 301
               else 200 end as status,
          case when page_id % 4 = 3 then 'otx' when page_id % 4 = 2 then 'wayback' else 'body' end as source
        from pages""",
    "rich_pages": f"""
        select p.page_id, p.url, p.html
          || case when p.page_id % 5 = 0 then '<form action="/login" method="post"></form>' else '' end
          || case when p.page_id % 7 = 0 then '<INPUT name="f" type="file">' else '' end
          || case when p.page_id % 3 = 0 then '<script src="/js/app.min.js"></script>' else '' end
          || case when p.page_id % 4 = 1 then '<script async src="../static/app' || cast(p.page_id as varchar(20))
               || '.js?v=1&amp;w=2"></script><script src="/x.css"></script>' else '' end
          || case when p.page_id % 11 = 0 then '<p>//bk' || cast(p.page_id as varchar(20))
               || '.s3.amazonaws.com/k https://d' || cast(p.page_id as varchar(20)) || '.cloudfront.net/x</p>'
             else '' end
          || case when p.page_id % 13 = 0 then '<a href="https://d' || cast(p.page_id as varchar(20))
               || '.cloudfront.net/y.png">c</a>' else '' end
          || '<a href="' || q.url || '">n</a><a href=''../up/./x?b=2&amp;a=1''>r</a><a href="mailto:a@b">m</a>'
          as html
        from pages p join pages q on q.page_id = (p.page_id * 7 + 3) % (select count(*) from pages)""",
    "js_assets": f"""
        select page_id, 'https://' || {HOST} || '/js/app' || {ID} || '.js' as url, 'https://' || {HOST} as site,
          'var a="/api/v' || cast(page_id % 4 as varchar(20)) || '/items?id=' || {ID} || '",b="' || url
          || '",c=''lib/util.min.js'',d="data.json",e="\\u002fesc%2Fq/z.php";' as body
        from pages""",
    "site_graph": """
        select a.url as from_url, b.url as to_url from pages a join pages b
          on b.page_id = a.page_id * 2 + 1 or b.page_id = a.page_id * 2 + 2
        union all
        select a.url, b.url from pages a join pages b on b.page_id = (a.page_id * 7 + 3) % (select count(*) from pages)
        """,
    "status_log": """
        select url, 'HEAD' as method, 200 + (page_id % 3) * 101 as status from pages where page_id % 6 <> 0
        union all
        select url, 'GET', 200 from pages where page_id % 15 <> 0""",
    "seeds": f"select min(page_id) as seed_id, {HOST} as site from pages group by 2",
    "robots": f"""
        select page_id, 'https://' || {HOST} || '/robots.txt' as url,
          'User-agent: *' || chr(10) || 'Disallow: /private/' || {ID} || chr(10) || 'Allow: /pub' || chr(10)
          || 'DISALLOW: ' || chr(10) || 'Disallow:' || chr(10) || 'x Allow: y Disallow: rel/../a?b#c' as body
        from pages""",
    "sitemaps": f"""
        select page_id, 'https://' || {HOST} || '/sitemap.xml' as url,
          '<urlset><url><loc>' || replace(url, '&', '&amp;') || '</loc></url></urlset>' as body
        from pages""",
    "sitemap_indexes": f"""
        select 'https://' || {HOST} || '/sitemap_index.xml' as url,
          '<sitemapindex><sitemap><loc>https://' || {HOST} || '/sitemap.xml</loc></sitemap><sitemap><loc>https://'
          || {HOST} || '/none.xml</loc></sitemap></sitemapindex>' as body
        from pages group by 1, 2""",
    "wayback": f"""
        select {DOMAIN} as domain, page_id as part, cast(0 as bigint) as page_no,
          '[["urlkey","timestamp","original","statuscode"],["k","202401' || lpad(cast(page_id % 28 + 1 as varchar(20)),
          2, '0') || '120000","' || url || '","' || case when page_id % 10 = 7 then '404' else '200' end
          || '"],["k","20230601000000","HTTPS://' || {HOST} || ':443//old//?z=1&y=' || {ID} || '","200"],'
          || '["short","row"]]' as payload
        from pages""",
    "commoncrawl": f"""
        select {DOMAIN} as domain, page_id as part, cast(0 as bigint) as page_no,
          case when page_id % 13 = 5 then '{{"url": "http'
               when page_id % 17 = 6 then '{{"timestamp": "20240101000000"}}'
               when page_id % 9 = 4 then '{{"url": "' || url || '"}}'
               else '{{"url": "' || url || '", "timestamp": "20240' || cast(page_id % 9 + 1 as varchar(20))
                    || '01000000"}}' end as payload
        from pages""",
    "virustotal": f"""
        select {DOMAIN} as domain, page_id as part, cast(0 as bigint) as page_no,
          '{{"detected_urls": [{{"url": "' || url || '"}}, {{"positives": 1}}]'
          || case when page_id % 3 = 0 then ', "undetected_urls": [{{"url": "http://' || {HOST} || '/v.gif?x='
               || {ID} || '"}}]' else '' end || '}}' as payload
        from pages""",
    "otx": f"""
        select {HOST} as domain, page_id as part, page_id // 8 as page_no,
          case when page_id % 17 = 6 then '{{"url_list": [], "has_next": true}}'
               else '{{"url_list": [{{"url": "' || url || '"}}, {{"url": "http://' || {HOST} || '/o' || {ID}
                    || '.PNG"}}], "has_next": ' || case when page_id % 15 = 4 then 'false' else 'true' end || '}}'
               end as payload
        from pages""",
    "urlscan": f"""
        select {DOMAIN} as domain, page_id as part, page_id % 12 as page_no,
          '{{"results": [{{"page": {{"url": "' || url || '"}}}}, {{"task": {{}}}}], "total": '
          || cast(50 + page_id % 7 * 173 as varchar(20)) || '}}' as payload
        from pages""",
    "grayhatwarfare": f"""
        select {DOMAIN} as domain, page_id as part, cast(0 as bigint) as page_no,
          case page_id % 5
            when 0 then '{{"files": [{{"url": "' || url || '", "bucket_url": "http://b' || {ID} || '.' || {DOMAIN}
              || '/"}}]}}'
            when 1 then '{{"results": [{{"url": "", "path": "/f/' || {ID} || '.txt", "bucket": "' || {DOMAIN}
              || '"}}]}}'
            when 2 then '{{"data": [{{"full_path": "g/' || {ID} || '", "bucket_name": "my-s3.' || {DOMAIN}
              || '"}}, {{"link": "https://other.test/q"}}]}}'
            when 3 then '{{"items": [{{"file_url": "bare/' || {DOMAIN} || '/' || {ID} || '"}}]}}'
            else '[{{"link": "' || url || '", "bucket_link": "https://' || {DOMAIN} || '"}}]' end as payload
        from pages""",
    "shodan": f"""
        select {DOMAIN} as domain, page_id as part, cast(0 as bigint) as page_no,
          '{{"matches": [{{"hostnames": ["' || {HOST} || '", "x.' || {HOST} || '"], "ip_str": "10.0.0.1", "port": '
          || case page_id % 3 when 0 then '443' when 1 then '80' else '8080' end
          || '}}, {{"hostnames": [], "ip_str": "10.1.' || cast(page_id % 200 as varchar(20)) || '.7", "port": 443}}, '
          || '{{"ip_str": "10.2.0.' || cast(page_id % 250 as varchar(20)) || '"}}, {{"port": 9}}]}}' as payload
        from pages""",
    "censys": f"""
        select {DOMAIN} as domain, page_id as part, cast(0 as bigint) as page_no,
          '{{"result": {{"hits": [{{"ip": "10.3.0.' || cast(page_id % 250 as varchar(20)) || '", "services": ['
          || '{{"port": ' || case page_id % 4 when 0 then '8443' when 1 then '8080' when 2 then '22' else '9000' end
          || ', "service_name": "' || case page_id % 3 when 0 then 'HTTP' else 'SSH' end
          || '", "tls": {{"certificates": {{"leaf_data": {{"subject": {{"common_name": ["' || {HOST} || '", "*.'
          || {DOMAIN} || '"]}}}}}}}}}}, {{"service_name": "smtp"}}]}}, {{"services": []}}]}}}}' as payload
        from pages""",
    "crawl_indexes": """
        select page_id, case when page_id % 4 = 0 then '[]' when page_id % 4 = 1 then 'oops'
          else '[{"id": "CC-MAIN-' || cast(2000 + page_id as varchar(20)) || '"}, {"id": "CC-MAIN-1999"}]' end
          as payload
        from pages""",
}

_NEXT = "(select page_id, url, html, (page_id * 7 + 3) % (select count(*) from pages) as next_id from pages)"

SPARK_SQL = {
    "rich_pages": SQL["rich_pages"].replace(
        "from pages p join pages q on q.page_id = (p.page_id * 7 + 3) % (select count(*) from pages)",
        f"from {_NEXT} p join pages q on q.page_id = p.next_id",
    ),
    "site_graph": f"""
        select a.url as from_url, b.url as to_url
        from (select url, explode(array(page_id * 2 + 1, page_id * 2 + 2)) as child from pages) a
          join pages b on b.page_id = a.child
        union all
        select a.url, b.url from {_NEXT} a join pages b on b.page_id = a.next_id""",
}

PROVIDER_TABLES = ["wayback", "commoncrawl", "otx", "urlscan", "virustotal", "grayhatwarfare", "shodan", "censys"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    text = SPARK_SQL.get(name, SQL[name]).replace(" // ", " div ").replace("\\u002f", "\\\\u002f")
    return spark.sql(text)


def payloads(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {p: derived(spark, sf_dir, p) for p in PROVIDER_TABLES}


def cte(*names: str) -> str:
    """The named inputs as common table expressions for a SQL text."""
    return ",\n".join(f"{n} as ({SQL[n]})" for n in names)
