"""A small client for S3's multipart uploads and signed addresses, over HTTP and the standard library.

It has the calls that stores make, under the names that other clients give them, so either will do.
Requests are signed by AWS Signature Version 4.  Keys, session token, region and endpoint are
arguments; what is not given comes from the usual public AWS_* variables of the process.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import http.client
import os
import time
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import quote, urlsplit
from xml.sax.saxutils import escape

#: Requests that a server answers with an error of its own are sent again, so often and after so many seconds.
RETRIES, WAIT = 4, 0.5
UNSIGNED = "UNSIGNED-PAYLOAD"


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)


def _variable(*names: str) -> str | None:
    return next((os.environ[n] for n in names if os.environ.get(n)), None)


@dataclass(frozen=True)
class Client:
    """endpoint: the address of another server than Amazon's; buckets are then the first part of the path."""

    access_key: str | None = None
    secret_key: str | None = field(default=None, repr=False)
    token: str | None = field(default=None, repr=False)
    region: str | None = None
    endpoint: str | None = None
    timeout: float = 300.0

    def _setting(self) -> tuple[str, str, str | None, str, str | None]:
        access = self.access_key or _variable("AWS_ACCESS_KEY_ID")
        secret = self.secret_key or _variable("AWS_SECRET_ACCESS_KEY")
        if not access or not secret:
            raise ValueError("an s3 address needs access_key and secret_key, or AWS_ACCESS_KEY_ID and AWS_SECRET_ACCESS_KEY")
        own = bool(self.access_key)
        token = self.token if own else self.token or _variable("AWS_SESSION_TOKEN")
        return access, secret, token, self.region or _variable("AWS_REGION", "AWS_DEFAULT_REGION") or "us-east-1", self.endpoint or _variable("AWS_ENDPOINT_URL")

    def checked(self) -> None:
        """Raises a ValueError where there are no keys."""
        self._setting()

    def _place(self, bucket: str, key: str, region: str, endpoint: str | None) -> tuple[str, str, str]:
        """Scheme, host and encoded path."""
        name = quote(key, safe="/-_.~")
        if endpoint:
            url = urlsplit(endpoint)
            return url.scheme, url.netloc, f"{url.path.rstrip('/')}/{bucket}/{name}"
        host = "s3.amazonaws.com" if region == "us-east-1" else f"s3.{region}.amazonaws.com"
        # A name with dots is no part of a host that certificates cover.
        return ("https", host, f"/{bucket}/{name}") if "." in bucket else ("https", f"{bucket}.{host}", f"/{name}")

    def _signature(self, method: str, path: str, query: str, headers: dict[str, str], payload: str, stamp: str, region: str, secret: str) -> str:
        names = sorted(headers)
        request = "\n".join([method, path, query, *(f"{n}:{headers[n].strip()}" for n in names), "", ";".join(names), payload])
        scope = f"{stamp[:8]}/{region}/s3/aws4_request"
        text = "\n".join(["AWS4-HMAC-SHA256", stamp, scope, hashlib.sha256(request.encode()).hexdigest()])
        key = f"AWS4{secret}".encode()
        for part in scope.split("/"):
            key = hmac.new(key, part.encode(), hashlib.sha256).digest()
        return hmac.new(key, text.encode(), hashlib.sha256).hexdigest()

    def _send(self, method: str, bucket: str, key: str, query: dict[str, str], body: bytes = b"") -> tuple[dict[str, str], bytes]:
        access, secret, token, region, endpoint = self._setting()
        scheme, host, path = self._place(bucket, key, region, endpoint)
        spelt = "&".join(f"{quote(k, safe='-_.~')}={quote(v, safe='-_.~')}" for k, v in sorted(query.items()))
        digest = hashlib.sha256(body).hexdigest()
        for left in reversed(range(RETRIES)):
            stamp = _now().strftime("%Y%m%dT%H%M%SZ")
            headers = {"host": host, "x-amz-content-sha256": digest, "x-amz-date": stamp, **({"x-amz-security-token": token} if token else {})}
            signature = self._signature(method, path, spelt, headers, digest, stamp, region, secret)
            sent = headers | {"authorization": f"AWS4-HMAC-SHA256 Credential={access}/{stamp[:8]}/{region}/s3/aws4_request, SignedHeaders={';'.join(sorted(headers))}, Signature={signature}", "content-length": str(len(body))}
            connection = (http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection)(host, timeout=self.timeout)
            try:
                connection.request(method, f"{path}?{spelt}" if spelt else path, body, sent)
                answer = connection.getresponse()
                data = answer.read()
                status, found = answer.status, {k.lower(): v for k, v in answer.getheaders()}
            except (OSError, http.client.HTTPException):
                if not left:
                    raise
                status = 0
            finally:
                connection.close()
            # An upload can fail after its answer has begun: then the error is in the body.
            failed = status == 0 or status >= 500 or status == 200 and b"<Error>" in data[:400]
            if not failed:
                break
            if left:
                time.sleep(WAIT * (RETRIES - left))
        if failed or status >= 300:
            raise OSError(f"{method} s3://{bucket}/{key}: {status} {data[:300].decode('utf-8', 'replace')}")
        return found, data

    # The calls of stores.  Their arguments have the names that other clients give them.

    def create_multipart_upload(self, Bucket: str, Key: str, **_: Any) -> dict[str, str]:  # noqa: N803
        _, data = self._send("POST", Bucket, Key, {"uploads": ""})
        return {"UploadId": next(x.text for x in ET.fromstring(data).iter() if x.tag.endswith("UploadId"))}  # noqa: S314  the store's answer

    def upload_part(self, Bucket: str, Key: str, UploadId: str, PartNumber: int, Body: bytes) -> dict[str, str]:  # noqa: N803
        headers, _ = self._send("PUT", Bucket, Key, {"partNumber": str(PartNumber), "uploadId": UploadId}, bytes(Body))
        return {"ETag": headers["etag"]}

    def complete_multipart_upload(self, Bucket: str, Key: str, UploadId: str, MultipartUpload: dict[str, Any]) -> dict[str, str]:  # noqa: N803
        rows = "".join(f"<Part><PartNumber>{p['PartNumber']}</PartNumber><ETag>{escape(p['ETag'])}</ETag></Part>" for p in MultipartUpload["Parts"])
        self._send("POST", Bucket, Key, {"uploadId": UploadId}, f"<CompleteMultipartUpload>{rows}</CompleteMultipartUpload>".encode())
        return {"Bucket": Bucket, "Key": Key}

    def abort_multipart_upload(self, Bucket: str, Key: str, UploadId: str) -> None:  # noqa: N803
        self._send("DELETE", Bucket, Key, {"uploadId": UploadId})

    def generate_presigned_url(self, ClientMethod: str, Params: dict[str, str], ExpiresIn: int) -> str:  # noqa: N803
        if ClientMethod != "get_object":
            raise ValueError("only addresses for reading are signed")
        access, secret, token, region, endpoint = self._setting()
        scheme, host, path = self._place(Params["Bucket"], Params["Key"], region, endpoint)
        stamp = _now().strftime("%Y%m%dT%H%M%SZ")
        query = {"X-Amz-Algorithm": "AWS4-HMAC-SHA256", "X-Amz-Credential": f"{access}/{stamp[:8]}/{region}/s3/aws4_request", "X-Amz-Date": stamp, "X-Amz-Expires": str(ExpiresIn), "X-Amz-SignedHeaders": "host", **({"X-Amz-Security-Token": token} if token else {})}
        spelt = "&".join(f"{k}={quote(v, safe='-_.~')}" for k, v in sorted(query.items()))
        return f"{scheme}://{host}{path}?{spelt}&X-Amz-Signature={self._signature('GET', path, spelt, {'host': host}, UNSIGNED, stamp, region, secret)}"


def client(**options: Any) -> Client:
    return Client(**options)
