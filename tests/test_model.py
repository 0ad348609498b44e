import json
import pickle
import urllib.error

from factloom.settings import Settings
from factloom.sources import model


class Answer:
    status, headers = 200, {}

    def __init__(self, body):
        self.body = body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None

    def read(self, n):
        return self.body[:n]


def test_answers_and_failures():
    seen = []

    def opener(request, timeout):
        told = json.loads(request.data)
        seen.append((request.full_url, told["model"], request.get_header("Authorization")))
        prompt = told["messages"][0]["content"]
        if prompt == "down":
            raise urllib.error.HTTPError(request.full_url, 500, "", {}, None)
        if prompt == "odd":
            return Answer(b"{}")
        return Answer(json.dumps({"choices": [{"message": {"content": f" {prompt}! "}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}).encode())

    e = model.ChatEndpoint("http://m.test/v1/", "k", {"cheap": "small", "strong": "large"}, opener=opener)
    assert e("rewrite", "cheap", ["a", "down", "odd"]) == [("a!", 3, 2), (None, 0, 0), (None, 0, 0)]
    assert e("rewrite", "strong", ["b"]) == [("b!", 3, 2)]
    assert seen[0] == ("http://m.test/v1/chat/completions", "small", "Bearer k") and seen[-1][1] == "large" and len(seen) == 4  # each is sent once


def test_settings_make_an_endpoint_only_when_complete():
    assert model.endpoint(Settings()) is None and model.missing(Settings(api_key="k")) == ["model_url", "model_id"]
    e = model.endpoint(Settings(model_url="http://m.test", api_key="k", model_id="small"))
    assert pickle.loads(pickle.dumps(e)).models == {"cheap": "small"}
