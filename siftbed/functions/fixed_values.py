"""Fixed values that decide about candidates: placeholders, published test numbers, reserved hosts, role mailboxes."""

from __future__ import annotations

# Words that mark an example, in lower case.
EXAMPLE_WORDS = ["example", "sample", "test", "dummy", "fake", "placeholder", "xxx", "your-", "your_", "replace", "<your", "insert", "todo", "changeme"]

# Hexadecimal strings of made-up keys.
SYNTHETIC_HEX = [
    "1a2b3c4d", "5e6f7a8b", "9c0d1e2f", "3a4b5c6d", "1a2b3c4d5e6f", "7a8b9c0d1e2f", "3a4b5c6d7e8f",
    "0a1b2c3d", "4e5f6a7b", "8c9d0e1f", "aabb", "aabbccdd", "deadbeef", "cafebabe",
]

# Fragments of made-up keys; two of them in one value give it away.
SYNTHETIC_FRAGMENTS = [
    "Kx4mBqWz", "7nJp2rVt", "9sYdFg5h", "Jk8qNr3b", "Rm7Kp3Wz", "9Qv2Nx8J", "t4Bf6Hs5", "Yd1Cg0Lk", "3Mw7Pr2T", "v9Xq4Zn8",
    "f3a8e2d7", "c9b04f56", "c9b0-4f56", "e2a8d1c9", "b70452f3", "a2d8-b704", "Xw6eAi0c", "DlG1fH7q", "s3cretP4ss", "s3cretPa55",
]

# Users, passwords and hosts of example connection strings.
DATABASE_USERS = [
    "user", "username", "admin", "root", "postgres", "mysql", "dbuser", "db_user", "myuser", "your_user", "your-user",
    "example", "test", "demo", "sample",
]
DATABASE_PASSWORDS = [
    "password", "passwd", "pass", "secret", "mysecret", "your_password", "your-password", "yourpassword", "changeme",
    "example", "test", "demo", "123456", "mypassword", "my_password", "dbpassword", "db_password",
]
DATABASE_HOSTS = [
    "host", "hostname", "localhost", "127.0.0.1", "0.0.0.0", "your-host", "your_host", "yourhost", "example.com",
    "db.example.com", "myhost", "host.example.com", "db", "database", "my-database", "mydb",
]

# Social security numbers that were published or are patterns.
PUBLISHED_SSNS = ["123456789", "111111111", "222222222", "333333333", "999999999", "078051120", "219099999"]

# Placeholders that stand for an assigned secret.
PLACEHOLDERS = [
    "password", "secret", "changeme", "test", "testing", "development", "your_secret_here", "your-secret-here",
    "your_token_here", "your_api_key", "your_api_key_here", "my_secret_key", "supersecret", "mysecret", "passw0rd",
    "admin123", "none", "null", "undefined", "empty", "default", "replace_me", "fixme", "todo", "placeholder",
]

# Card numbers that payment services publish for tests.
TEST_CARDS = [
    "4111111111111111", "4242424242424242", "5555555555554444", "5105105105105100", "378282246310005", "371449635398431",
    "6011111111111117", "6011000990139424", "3530111333300000", "3566002020360505", "4000056655665556", "5200828282828210",
    "4000000000000077", "4000000000000093", "4000000000000127", "4000000000000002", "4000000000009995", "4000000000000069",
    "4000000000000341", "4012888888881881", "5425233430109903", "2223000048410010", "6759649826438453", "3056930009020004",
    "3852000002323676", "6271136264806203568", "36227206271667",
]

# Parts of addresses that no person reads, mailboxes of roles, and domains that name no one.
AUTOMATIC_MAILBOXES = [
    "noreply@", "no-reply@", "donotreply@", "do-not-reply@", "mailer-daemon@", "postmaster@", "notifications@",
    "github-noreply@", "bot@", "auto@", "automated@",
]
ROLE_MAILBOXES = [
    "hello", "hi", "hey", "info", "contact", "support", "help", "sales", "marketing", "press", "media", "legal", "privacy",
    "security", "abuse", "admin", "webmaster", "hostmaster", "billing", "invoices", "accounts", "feedback", "team",
    "dmarc-reports", "dmarc", "dmarcreports", "bounces", "unsubscribe", "subscribe", "newsletter", "alerts",
]
IMPERSONAL_DOMAINS = [
    "example.com", "example.org", "example.net", "test.com", "test.org", "localhost", "users.noreply.github.com",
    "anthropic.com", "github.com", "email.com", "placeholder.com", "gmail.com", "googlemail.com", "outlook.com",
    "hotmail.com", "yahoo.com", "icloud.com", "protonmail.com", "proton.me", "google.com", "microsoft.com", "apple.com",
    "amazon.com", "stripe.com", "sendgrid.net", "mailgun.com", "postmarkapp.com", "pypi.org", "npmjs.com", "rubygems.org",
    "crates.io", "travis-ci.org", "circleci.com", "github.io", "company.com", "acme.com", "acme-corp.com", "corp.com",
    "mycompany.com", "yourcompany.com", "domain.com", "foo.com", "bar.com", "baz.com", "foobar.com", "contoso.com",
    "fabrikam.com", "northwind.com", "sentry.io",
]

# Bank account numbers of the documentation of IBAN.
PUBLISHED_IBANS = [
    "DE89370400440532013000", "GB29NWBK60161331926819", "FR7630006000011234567890189", "ES9121000418450200051332",
    "IT60X0542811101000000123456", "NL91ABNA0417164300", "BE68539007547034", "CH9300762011623852957", "AT611904300234573201",
]

# User pools of the documentation, and hosts and users of addresses that are no leak.
SAMPLE_POOLS = ["abcdef123", "abc123def", "example12"]
LOCAL_ADDRESSES = ["://localhost", "://127.0.0.1", "://0.0.0.0", "://[::1]"]
CLONE_USERS = ["x-access-token:", "oauth2:"]
