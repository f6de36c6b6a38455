"""What auth messages say (S7): event, result and fields, by how each program words its messages.

A message is known by its first words; fields are then taken from it by one rule for each program (what stands before
`port`, between quotes, in brackets, behind a name and an equals sign).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.net import key_values

#: Fields that a message may tell.
TOLD = ("user", "address", "port", "auth_method", "key_type", "key_fingerprint", "src_user", "src_uid", "group", "gid", "uid", "changed_attr", "old_value", "new_value", "shell", "command", "tty", "pam_service", "reason", "repeat")

#: Programs that manage accounts, and first words of messages with their event and result.
ACCOUNT_PROGRAMS = ("adduser", "chage", "chfn", "chpasswd", "chsh", "deluser", "gpasswd", "groupadd", "groupdel", "groupmod", "newusers", "passwd", "useradd", "userdel", "usermod")
SSHD = (
    ("Accepted ", "ssh_accepted", "success"), ("Failed ", "ssh_failed", "failure"), ("Invalid user ", "ssh_invalid_user", "failure"), ("error: maximum authentication attempts", "ssh_max_auth", "failure"),
    ("Connection closed by ", "ssh_probe", "failure"), ("Connection reset by ", "ssh_probe", "failure"), ("Disconnected from ", "ssh_probe", "failure"), ("Did not receive identification string ", "ssh_probe", "failure"),
    ("Unable to negotiate with ", "ssh_probe", "failure"), ("banner exchange", "ssh_probe", "failure"), ("error: banner exchange", "ssh_probe", "failure"), ("kex_", "ssh_probe", "failure"), ("error: kex_", "ssh_probe", "failure"),
    ("Received disconnect from ", "ssh_disconnect", "info"), ("AuthorizedKeysCommand ", "ssh_keys_command", "info"), ("Server listening on ", "sshd_service", "info"), ("Received signal ", "sshd_service", "info"), ("Received SIGHUP", "sshd_service", "info"),
)
ACCOUNT = (
    ("new user: ", "user_created", "success"), ("new group: ", "group_created", "success"), ("change user ", "user_modified", "success"), ("changed user ", "user_modified", "success"),
    ("delete user ", "user_deleted", "success"), ("password for ", "password_changed", "success"), ("password changed for ", "password_changed", "success"), ("add ", "group_member_added", "success"),
    ("delete ", "group_member_removed", "success"), ("user ", "group_member_added", "success"), ("removed group ", "group_deleted", "success"), ("group ", "group_deleted", "success"),
)
PAM_EVENTS = (("authentication failure;", "pam_auth_failure", "failure"), ("auth could not identify password for ", "pam_auth_failure", "failure"), ("session opened for user ", "pam_session_opened", "success"), ("session closed for user ", "pam_session_closed", "info"), ("password changed for ", "password_changed", "success"))
DENIED = ("command not allowed", "NOT in sudoers", "incorrect password")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern, null where it is empty or nothing fits."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _word(text: Column, n: int) -> Column:
    return F.nullif(F.get(F.split(text, " "), F.lit(n)), F.lit(""))


def _said(event: Column | str, result: Column | str, **fields: Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(event).alias("event"), as_column(result).alias("result"), *((fields[c].cast("string") if c in fields else F.lit(None).cast("string")).alias(c) for c in TOLD))


def _first(text: Column, table: tuple[tuple[str, str, str], ...], column: int) -> Column:
    """The event or result of the first row of a table whose words the text begins with."""
    out = None
    for row in table:
        hit = F.startswith(text, F.lit(row[0]))
        out = F.when(hit, row[column]) if out is None else out.when(hit, row[column])
    return out


def _name(token: Column) -> Column:
    """name or name(uid=0)"""
    return F.nullif(F.substring_index(token, "(", 1), F.lit(""))


PAM_HEADER = r"^pam_\w+\(([^:)]+):\w+\): "


def pam_values(msg: Column) -> Column:
    """The name=value pairs of a message that tells of a failure, else null; to be made once, as a column, for many fields."""
    return F.when(F.contains(msg, F.lit("authentication failure")), key_values(F.regexp_replace(msg, PAM_HEADER, "")))


def pam(msg: Column, values: Column | None = None) -> Column:
    """Messages of any PAM module, and sshd's count of further failures. values: of pam_values(), if they are there."""
    header = PAM_HEADER
    body = F.regexp_replace(msg, header, "")
    kv, service = pam_values(msg) if values is None else values, _found(msg, header)
    who = F.coalesce(F.nullif(kv["ruser"], F.lit("")), F.nullif(kv["logname"], F.lit("")))
    failed = {"user": F.nullif(kv["user"], F.lit("")), "address": F.nullif(kv["rhost"], F.lit("")), "src_user": who, "src_uid": kv["uid"], "tty": F.nullif(kv["tty"], F.lit(""))}
    unknown = _found(body, r"\[([^\]]+)\]$")
    opened = F.startswith(body, F.lit("session opened"))
    uid = lambda n: _found(_word(body, n), r"uid=(\d+)")
    event, result = (F.coalesce(_first(body, PAM_EVENTS, k), F.lit(other)) for k, other in ((1, "pam_other"), (2, "info")))
    more = F.startswith(msg, F.lit("PAM ")) & F.contains(msg, F.lit(" more authentication failure"))
    return (
        F.when(more, _said("pam_auth_failure", "failure", repeat=_word(msg, 1), **failed))
        .when(~msg.rlike(header), None)
        .when(F.startswith(body, F.lit("authentication failure;")), _said(event, result, pam_service=service, **failed))
        .when(F.startswith(body, F.lit("auth could not")), _said(event, result, pam_service=service, user=unknown, src_user=F.when(service == "sudo", unknown), reason=F.lit("could not identify password")))
        .when(opened, _said(event, result, pam_service=service, user=_name(_word(body, 4)), uid=uid(4), src_user=_name(_word(body, 6)), src_uid=uid(6)))
        .when(F.startswith(body, F.lit("session closed")), _said(event, result, pam_service=service, user=_word(body, 4)))
        .otherwise(_said(event, result, pam_service=service, user=F.when(F.startswith(body, F.lit("password changed")), _word(body, 3))))
    )


def sshd(msg: Column) -> Column:
    """The client stands before `port`, the account between `for` and `from` or behind `user`; names may hold blanks and
    these words themselves, so the last place counts."""
    event, result = _first(msg, SSHD, 1), _first(msg, SSHD, 2)
    left = msg.rlike(r"^(?:Connection closed by|Connection reset by|Disconnected from|Disconnecting) (?:authenticating|invalid) user ")
    ended = F.startswith(msg, F.lit("Disconnected from user "))
    event = F.when(left, "ssh_auth_fail_close").when(ended, "ssh_disconnect").otherwise(event)
    result = F.when(left, "failure").when(ended, "info").otherwise(result)
    login = event.isin("ssh_accepted", "ssh_failed")
    service = result == "info"
    user = F.coalesce(_found(msg, r" for (?:invalid user )?(.*) from \S+ port \d+"), _found(msg, r"^Invalid user (.*) from \S+"), _found(msg, r" user (.*) \S+ port \d+"))
    address = F.coalesce(_found(msg, r".*?(\S+) port \d+(?!.* port \d)"), _found(msg, r" from (\S+)$"))
    told = _said(
        event, result, user=user, address=F.when(~service | F.contains(msg, F.lit("isconnect")), address), port=F.when(event != "sshd_service", _found(msg, r" port (\d+)(?!.* port \d)")), auth_method=F.when(login, _word(msg, 1)),
        key_type=_found(msg, r" ssh2: (\S+) \S+"), key_fingerprint=_found(msg, r" ssh2: \S+ (\S+)"),
    )
    return F.when(event.isNotNull(), told)


def sudo(msg: Column) -> Column:
    """who : [why not ;] TTY=… ; PWD=… ; USER=… ; COMMAND=…"""
    named = lambda n: _found(msg, rf"\b{n}=([^;]*?)(?: ;|$)")
    fields = {"src_user": F.trim(F.substring_index(msg, " : ", 1)), "user": named("USER"), "tty": named("TTY"), "command": _found(msg, r"\bCOMMAND=(.*)$")}
    why = F.lit(False)
    for x in DENIED:
        why = why | F.contains(F.substring_index(msg, "COMMAND=", 1), F.lit(x))
    return F.when(F.contains(msg, F.lit(" : ")) & why, _said("sudo_denied", "failure", **fields)).when(fields["user"].isNotNull() & fields["command"].isNotNull(), _said("sudo_command", "success", **fields))


def su(msg: Column) -> Column:
    sides = F.split(_word(msg, 2), ":")
    return (
        F.when(F.startswith(msg, F.lit("Successful su for ")), _said("su_success", "success", user=_word(msg, 3), src_user=_word(msg, 5)))
        .when(F.startswith(msg, F.lit("FAILED su for ")), _said("su_failure", "failure", user=_word(msg, 3), src_user=_word(msg, 5)))
        .when(F.startswith(msg, F.lit("- ")) & F.contains(msg, F.lit(":")), _said("su_failure", "failure", tty=_word(msg, 1), src_user=F.get(sides, F.lit(0)), user=F.get(sides, F.lit(1))))
        .otherwise(_said("su_other", "info"))
    )


def accounts(msg: Column) -> Column:
    """Quoted names in order; new users and groups as name=value lists; gpasswd's sentences by words."""
    quoted = F.regexp_extract_all(msg, F.lit("'([^']*)'"), 1)
    q = lambda n: F.nullif(F.get(quoted, F.lit(n)), F.lit(""))
    listed = lambda n: F.nullif(F.trim(_found(msg, rf"\b{n}=([^,]*)")), F.lit(""))
    event, result = _first(msg, ACCOUNT, 1), _first(msg, ACCOUNT, 2)
    begins = lambda x: F.startswith(msg, F.lit(x))
    attr = _found(msg, r"^changed? user '[^']*' (\S+)")
    new = F.element_at(quoted, -1)
    changed = {"user": q(0), "changed_attr": attr, "old_value": F.when(F.size(quoted) > 2, q(1)), "new_value": F.when(F.size(quoted) > 1, new), "uid": F.when(attr == "UID", new), "shell": F.when(attr == "shell", new)}
    removed = F.contains(msg, F.lit(" removed by "))
    return (
        F.when(begins("new user: "), _said(event, result, user=listed("name"), uid=listed("UID"), gid=listed("GID"), shell=listed("shell")))
        .when(begins("new group: "), _said(event, result, group=listed("name"), gid=listed("GID")))
        .when(begins("change user ") & F.endswith(msg, F.lit(" password")), _said("password_changed", result, user=q(0)))
        .when((begins("change user ") | begins("changed user ")) & attr.isNotNull(), _said(event, result, **changed))
        .when(begins("delete user '"), _said(event, result, user=q(0)))
        .when(begins("password for '"), _said(event, result, user=q(0), src_user=q(1)))
        .when(begins("password changed for "), _said(event, result, user=_word(msg, 3)))
        .when(begins("add '"), _said(F.when(F.contains(msg, F.lit(" shadow group ")), "gshadow_member_added").otherwise(event), result, user=q(0), group=q(1)))
        .when(begins("delete '"), _said(event, result, user=q(0), group=q(1)))
        .when(begins("user ") & msg.rlike(r"^user \S+ (?:added|removed) by \S+ (?:to|from) group \S+"), _said(F.when(removed, "group_member_removed").otherwise(event), result, user=_word(msg, 1), src_user=_word(msg, 4), group=_word(msg, 7)))
        .when((begins("removed group '") | begins("group '")) & (F.size(quoted) == 1), _said(event, result, group=q(0)))
        .otherwise(_said("account_other", "info"))
    )


def pkexec(msg: Column) -> Column:
    named = lambda n: _found(msg, rf"\[{n}=([^\]]*)\]")
    who = F.substring_index(msg, ":", 1)
    return (
        F.when(F.contains(msg, F.lit(": Executing command ")), _said("pkexec_command", "success", src_user=who, user=named("USER"), tty=named("TTY"), command=named("COMMAND")))
        .when(msg.rlike(r"^\S+: (?:Error|The value)"), _said("pkexec_denied", "failure", src_user=who))
    )


def logind(msg: Column) -> Column:
    """Sessions of the login manager; PAM's own messages tell the logins."""
    session = F.concat(F.lit("session "), F.regexp_replace(_word(msg, 2), r"\.$", ""))
    return (
        F.when(msg.rlike(r"^New session \S+ of user \S+"), _said("session_new", "info", user=F.regexp_replace(_word(msg, 5), r"\.$", ""), reason=session))
        .when(F.startswith(msg, F.lit("Removed session ")), _said("session_removed", "info", reason=session)).otherwise(_said("logind_other", "info"))
    )


def classified(program: Column, msg: Column, values: Column | None = None) -> Column:
    """Struct of event, result and the fields of TOLD, as strings. PAM's wording counts whatever the program; what is not known is `other`."""
    by = F.when(program == "sshd", sshd(msg)).when(program == "sudo", sudo(msg)).when(program == "su", su(msg)).when(program == "pkexec", pkexec(msg)).when(program == "systemd-logind", logind(msg)).when(program.isin(*ACCOUNT_PROGRAMS), accounts(msg))
    return F.coalesce(pam(msg, values), by, _said("other", "info"))
