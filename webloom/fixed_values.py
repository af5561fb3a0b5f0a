"""Word lists, lookup tables, patterns and formats that results depend on.

Everything here is data.
"""

# -- media, font and style files that a crawl never visits ------------------------------------------------------------
BLACKLISTED_EXTENSIONS = [
    "png", "apng", "bmp", "gif", "ico", "cur", "jpg", "jpeg", "jfif", "pjp", "pjpeg", "svg", "tif", "tiff", "webp", "xbm",
    "3gp", "aac", "flac", "mpg", "mpeg", "mp3", "mp4", "m4a", "m4v", "m4p", "oga", "ogg", "ogv", "mov", "wav", "webm", "eot",
    "woff", "woff2", "ttf", "otf", "css",
]

# -- well-known sitemap locations -------------------------------------------------------------------------------------
SITEMAP_PATHS = [
    "/sitemap.xml",
    "/sitemap_news.xml",
    "/sitemap_index.xml",
    "/sitemap-index.xml",
    "/sitemapindex.xml",
    "/sitemap-news.xml",
    "/post-sitemap.xml",
    "/page-sitemap.xml",
    "/portfolio-sitemap.xml",
    "/home_slider-sitemap.xml",
    "/category-sitemap.xml",
    "/author-sitemap.xml",
]

# -- archives and scanners, in declared order (the order decides which one keeps a shared URL) ------------------------
PROVIDERS = ["wayback", "commoncrawl", "otx", "urlscan", "virustotal", "grayhatwarfare", "shodan", "censys"]

# -- record types -----------------------------------------------------------------------------------------------------
URL_TYPES = ["url", "href", "sitemap", "robots", "linkfinder"]
SUBDOMAIN_TYPES = ["subdomain", "subdomains"]
FORM_TYPES = ["form", "upload-form"]
SHOWN_TYPES = ["javascript", "subdomains", "subdomain", "form", "upload-form", "aws-s3"]
PASSIVE_PREFIX = "passive-"

# -- display names ----------------------------------------------------------------------------------------------------
SOURCE_LABELS = {
    "body": "WEB",
    "javascript": "WEB",
    "linkfinder": "WEB",
    "wayback": "Wayback Machine",
    "commoncrawl": "Common Crawl",
    "otx": "OTX",
    "urlscan": "URLScan",
    "virustotal": "VirusTotal",
    "grayhatwarfare": "GrayHatWarfare",
    "shodan": "Shodan",
    "censys": "Censys",
    "sitemap": "Sitemap",
    "robots": "Robots",
}
PROVIDER_LABELS = {
    "wayback": "Wayback machine",
    "commoncrawl": "Common Crawl",
    "otx": "OTX",
    "urlscan": "URLScan",
    "virustotal": "VirusTotal",
    "grayhatwarfare": "GrayHatWarfare",
    "shodan": "Shodan",
    "censys": "Censys",
}
CLEAN_TAGS = {
    "url": "URL",
    "href": "URL",
    "sitemap": "URL",
    "robots": "URL",
    "linkfinder": "URL",
    "javascript": "JAVASCRIPT",
    "subdomain": "SUBDOMAIN",
    "subdomains": "SUBDOMAIN",
    "form": "FORM",
    "upload-form": "FORM",
    "aws-s3": "AWS S3",
}
SUMMARY_LABELS = {
    "urls": "URLs discovered",
    "subdomains": "Subdomains found",
    "javascript": "JavaScript files",
    "forms": "Forms found",
    "aws_s3": "AWS S3 Buckets",
    "aws_cloudfront": "AWS CloudFront URLs",
}

# -- provider limits --------------------------------------------------------------------------------------------------
URLSCAN_PAGE_SIZE = 100
CENSYS_PORTS = [80, 443, 8080, 8443]
CENSYS_TLS_PORTS = [443, 8443]
FALLBACK_CRAWL_INDEX = "CC-MAIN-2023-23"

# -- script links: full URLs, rooted and relative paths, path/file.ext, path/name, file.ext -- always in quotes. What the
# linear scan in the extraction must find; used to compare with it. ------------------------------------------------------
SCRIPT_LINK = r"""(?:"|')(((?:[a-zA-Z]{1,10}://|//)[^"'/]{1,}\.[a-zA-Z]{2,}[^"']{0,})|((?:/|\.\./|\./)[^"'><,;| *()(%%$^/\\\[\]][^"'><,;|()]{1,})|([a-zA-Z0-9_\-/]{1,}/[a-zA-Z0-9_\-/]{1,}\.(?:[a-zA-Z]{1,4}|action)(?:[\?|#][^"|']{0,}|))|([a-zA-Z0-9_\-/]{1,}/[a-zA-Z0-9_\-/]{3,}(?:[\?|#][^"|']{0,}|))|([a-zA-Z0-9_\-]{1,}\.(?:php|asp|aspx|jsp|json|action|html|js|txt|xml)(?:[\?|#][^"|']{0,}|)))(?:"|')"""

# -- one DNS label, and the percent-code residues stripped from the front of a name -----------------------------------
DNS_LABEL = r"(?:[a-zA-Z0-9]|[_a-zA-Z0-9][_a-zA-Z0-9-]{0,61}[a-zA-Z0-9])"
NAME_RESIDUES = ["20", "25", "2b", "2f", "3d", "3a", "40"]

# -- bucket names: host form, one-character region form, website form, path form, regional path form ------------------
BUCKET_FORMS = [
    r"[a-z0-9.-]+\.s3\.amazonaws\.com",
    r"[a-z0-9.-]+\.s3-[a-z0-9-]\.amazonaws\.com",
    r"[a-z0-9.-]+\.s3-website[.-](?:eu|ap|us|ca|sa|cn)",
    r"//s3\.amazonaws\.com/[a-z0-9._-]+",
    r"//s3-[a-z0-9-]+\.amazonaws\.com/[a-z0-9._-]+",
]

# -- schemes that take part in relative resolution, and those whose last path segment may carry ;parameters ------------
WEB_SCHEMES = ["http", "https"]

# -- characters that str.strip() removes, and those a URL parser drops ------------------------------------------------
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
C0_AND_BLANK = "".join(map(chr, range(1, 33)))
