"""Declared schemas: landing files as they come, the lake as it is kept."""

from __future__ import annotations

REVIEW_LANDING = (
    "recommendationid string, appid bigint, author struct<steamid:string,num_games_owned:int,num_reviews:int,playtime_forever:int,playtime_last_two_weeks:int,playtime_at_review:int,last_played:bigint>, "
    "review string, language string, timestamp_created bigint, timestamp_updated bigint, voted_up boolean, votes_up bigint, votes_funny bigint, weighted_vote_score string, comment_count int, "
    "steam_purchase boolean, received_for_free boolean, refunded boolean, written_during_early_access boolean, primarily_steam_deck boolean, collected_ts bigint"
)
REVIEW = (
    "recommendationid bigint, appid bigint, steam_id bigint, review_text string, language_code string, created_ts bigint, updated_ts bigint, voted_up boolean, votes_up int, votes_funny int, "
    "weighted_vote_score double, comment_count int, steam_purchase boolean, received_for_free boolean, refunded boolean, written_during_early_access boolean, primarily_steam_deck boolean, "
    "playtime_at_review int, playtime_forever int, playtime_last_two_weeks int, num_games_owned int, num_reviews int, last_played bigint, collected_ts bigint"
)
REVIEW_KEY = ("recommendationid", "updated_ts")
NOTICE_LANDING = "gid string, appid bigint, title string, contents string, url string, author string, feedname string, feedlabel string, feed_type int, date bigint, tags array<string>, is_external_url boolean, collected_ts bigint"
NOTICE = "gid string, appid bigint, title string, contents string, url string, author string, feedname string, feedlabel string, feed_type int, published_ts bigint, tags string, is_external_url boolean, collected_ts bigint"
JUDGED = ("is_patch", "patch_reason")
NOTICE_KEY = ("gid", "collected_ts")


def columns(schema: str) -> list[str]:
    depth, out, part = 0, [], ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.split()[0])
            part = ""
        else:
            part += c
    return out
